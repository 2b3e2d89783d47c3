"""The service's calls, by direct dispatch and once over HTTP."""

import json
import threading
import time
import urllib.request

import pytest

from codicil.plans.service import Service, routed, serve


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    def parse(content):
        if content.startswith(b"locked"):
            raise ValueError("encrypted")
        return content.decode().split("\f")

    s = Service(spark, str(tmp_path_factory.mktemp("service")), parser=parse, method="recursive", threshold=0.1, answer=lambda prompts: ["It is so [SOURCE_1] [SOURCE_1]." for _ in prompts])
    assert routed(s, "GET", "/health", {})[1]["indexed_chunks"] == 0
    assert routed(s, "POST", "/query", {"question": "rent"})[1]["refused"]
    files = {"lease.pdf": b"The rent is due on the first day of the month.", "note.pdf": b"The garden is open to all guests.", "bad.txt": b"x", "shut.pdf": b"locked"}
    status, done = routed(s, "POST", "/ingest", {"files": [{"filename": n, "content_hex": c.hex()} for n, c in files.items()]})
    assert status == 200 and {r["filename"]: r["error"] for r in done} == {"lease.pdf": None, "note.pdf": None, "bad.txt": "not_a_pdf", "shut.pdf": "encrypted"}
    return s


def test_documents_and_query(service):
    docs = {d["filename"]: d["document_id"] for d in routed(service, "GET", "/documents", {})[1]}
    assert set(docs) == {"lease.pdf", "note.pdf"}
    status, out = routed(service, "POST", "/query", {"question": "When is the rent due?"})
    assert status == 200 and out["trace"][0]["snippet"].startswith("The rent") and len(out["citations"]) == 1
    assert routed(service, "POST", "/query", {"question": " "})[0] == 400
    for ids, found in (([docs["note.pdf"]], False), ([docs["lease.pdf"]], True), ([], False)):
        out = routed(service, "POST", "/query", {"question": "When is the rent due?", "filters": {"document_ids": ids}})[1]
        assert any(t["snippet"].startswith("The rent") for t in out["trace"]) == found
    status, out = routed(service, "POST", "/query", {"question": "rent", "filters": {"author": "x"}})
    assert status == 400 and "author" in out["error"]


def test_cases_scope_the_search(service):
    docs = {d["filename"]: d["document_id"] for d in service.documents()}
    case = routed(service, "POST", "/cases", {"name": "one"})[1]["case_id"]
    assert routed(service, "POST", "/query", {"question": "rent due", "case_id": case})[1]["reason"] == "empty_case"
    assert routed(service, "POST", "/query", {"question": "rent due", "case_id": "none"})[0] == 404
    for _ in range(2):
        assert routed(service, "POST", f"/cases/{case}/documents", {"document_id": docs["note.pdf"]})[1]["document_ids"] == [docs["note.pdf"]]
    out = routed(service, "POST", "/query", {"question": "the garden is open", "case_id": case})[1]
    assert [t["snippet"][:10] for t in out["trace"]] == ["The garden"]
    assert routed(service, "DELETE", f"/cases/{case}/documents/{docs['note.pdf']}", {})[1]["document_ids"] == []
    assert routed(service, "GET", "/cases/none", {})[0] == 404


def test_evaluation(service, tmp_path):
    questions = [{"id": "1", "question": "When is the rent due?", "question_type": "direct", "is_out_of_corpus": False, "expected_document": "lease.pdf", "expected_answer_span": "due on the first day"}]
    (tmp_path / "q.json").write_text(json.dumps({"metadata": {"version": "1"}, "questions": questions}))
    status, out = routed(service, "POST", "/evaluate", {"dataset": str(tmp_path / "q.json")})
    assert status == 202
    for _ in range(240):
        told = routed(service, "GET", f"/evaluate/{out['id']}", {})[1]
        if told["status"] in ("done", "failed"):
            break
        time.sleep(0.5)
    assert told["status"] == "done", told
    assert told["summary"][0]["recall_at_1"] == 1.0
    assert len(routed(service, "GET", "/evaluate/runs", {})[1]) == 2  # overall and by type


def test_http_and_delete(service):
    server = serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{at}/health"))["indexed_chunks"] == 2
    doc = next(d["document_id"] for d in service.documents() if d["filename"] == "note.pdf")
    assert routed(service, "DELETE", f"/documents/{doc}", {})[1]["deleted"] == 1
    assert json.load(urllib.request.urlopen(f"{at}/health"))["indexed_chunks"] == 1
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/nothing")
    server.shutdown()
