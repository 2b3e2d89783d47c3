"""The calls of a REST service, over tables in one folder, and a small HTTP server for them.

Each call is a few DataFrame steps; what a caller gets is plain dicts and lists. Embeddings and answers come
from injected functions; without them the hashed stand-in embeds, and questions get their sources only.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import bm25, evaluation, fusion, generation, knn, retrieve
from codicil.operators.chunking import METHODS, chunk
from codicil.sources import catalog, documents, embedding

INSTRUCTIONS = "Answer from the sources alone and cite them as [SOURCE_n]. If they do not answer, say that you could not find this information."
CATALOG = "document_id string, filename string, category string, file_size long, uploaded timestamp"
CASES = "case_id string, name string, description string, created_at timestamp"
LINKS = "case_id string, document_id string"


class NotFound(LookupError):
    """A case or run that does not exist."""


class Service:
    """Tables: catalog, chunks (a directory per chunking method), cases, links. One writer."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        *,
        parser: documents.PageParser | None = None,
        embed: Callable[[Column], Column] = embedding.hashed_vector,
        answer: Callable[[list[str]], list[str]] | None = None,
        method: str = "legal",
        threshold: float = 0.35,
    ):
        self.spark, self.root, self.parser, self.embed, self.answer = spark, root.rstrip("/"), parser, embed, answer
        self.method, self.threshold, self.lock = method, threshold, threading.Lock()
        self.runs: dict[str, dict] = {}

    # ---- tables

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _version(self, name: str) -> str | None:
        """The folder of the newest version of a table; null where there is none."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return None
        versions = sorted(f.getPath().getName() for f in files.listStatus(at) if f.getPath().getName().startswith("version="))
        return versions[-1] if versions else None

    def _latest(self, name: str) -> DataFrame | None:
        """The newest version of a table, also if it has no rows; null where there is none."""
        version = self._version(name)
        return None if version is None else self.spark.read.parquet(f"{self._path(name)}/{version}")

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self._latest(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _write(self, name: str, rows: DataFrame) -> None:
        """A new version beside the old ones: readers keep what they read, and a failed write changes nothing."""
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")
        rows.write.parquet(f"{self._path(name)}/version={stamp}")

    def _chunks(self, method: str) -> DataFrame | None:
        return self._latest(f"chunks/{method}")

    def _write_chunks(self, method: str, rows: DataFrame) -> None:
        """A new version of the chunks, and its BM25 index under the same name."""
        self._write(f"chunks/{method}", rows)
        bm25.build(self._chunks(method), unique=True).save(self._path(f"bm25/{method}/{self._version(f'chunks/{method}')}"))

    def _index(self, method: str) -> bm25.Index | bm25.SavedIndex:
        """The saved index of the newest chunks; where its writing was cut short, one made on the way."""
        try:
            return bm25.load(self.spark, self._path(f"bm25/{method}/{self._version(f'chunks/{method}')}"))
        except AnalysisException:
            return bm25.build(self._chunks(method), unique=True)

    # ---- calls

    def health(self) -> dict:
        chunks = self._chunks(self.method)
        return {"status": "ok", "indexed_chunks": chunks.count() if chunks is not None else 0, "chunking_method": self.method, "methods": sorted(METHODS)}

    def ingest(self, files: list[tuple[str, bytes]], category: str | None = None, method: str | None = None) -> list[dict]:
        """Checks, parses, chunks, embeds and indexes files; each gets its document id or the reason why not."""
        if self.parser is None:
            raise ValueError("no page parser is configured")
        with self.lock:
            rows = self.spark.createDataFrame([(n, bytearray(c), category) for n, c in files], "filename string, content binary, category string")
            checked = documents.identified(documents.validated(rows)).withColumn("file_size", F.octet_length("content").cast("long")).persist()
            pages, bad = documents.parse_pages(checked.filter("error IS NULL").dropDuplicates(["document_id"]), self.parser)
            new = chunk(pages.persist(), method or self.method).withColumn("vector", self.embed(F.col("text")))
            current = self._chunks(method or self.method)
            self._write_chunks(method or self.method, new if current is None else catalog.replace_document(current, new))
            done = pages.select("document_id").distinct()
            entries = checked.join(done, "document_id", "left_semi").select("document_id", "filename", "category", "file_size", F.current_timestamp().alias("uploaded"))
            self._write("catalog", catalog.upsert(self._read("catalog", CATALOG), entries, "document_id"))
            told = checked.join(bad.select("document_id", F.col("error").alias("_e")).distinct(), "document_id", "left")
            return [r.asDict() for r in told.select("filename", "document_id", F.coalesce("error", "_e").alias("error")).collect()]

    def documents(self) -> list[dict]:
        return [r.asDict() for r in self._read("catalog", CATALOG).orderBy("uploaded").collect()]

    def delete_document(self, document_id: str) -> int:
        with self.lock:
            gone, n = self.spark.createDataFrame([(document_id,)], "document_id string"), 0
            for method in METHODS:
                if (chunks := self._chunks(method)) is not None:
                    left, counts = catalog.delete(chunks, gone)
                    n += counts.first()["deleted"]
                    self._write_chunks(method, left)
            self._write("catalog", catalog.delete(self._read("catalog", CATALOG), gone)[0])
            return n

    def create_case(self, name: str, description: str | None = None) -> dict:
        with self.lock:
            row = self.spark.createDataFrame([(uuid.uuid4().hex, name, description, datetime.now(timezone.utc))], CASES)
            self._write("cases", self._read("cases", CASES).unionByName(row))
            return row.first().asDict()

    def cases(self) -> list[dict]:
        return [r.asDict() for r in catalog.case_list(self._read("cases", CASES), self._read("links", LINKS)).orderBy("created_at").collect()]

    def case(self, case_id: str) -> dict:
        one = F.col("case_id") == case_id
        found = catalog.case_list(self._read("cases", CASES).filter(one), self._read("links", LINKS).filter(one)).first()
        if found is None:
            raise NotFound(case_id)
        return found.asDict()

    def add_to_case(self, case_id: str, document_id: str) -> dict:
        self.case(case_id)
        with self.lock:
            new = self.spark.createDataFrame([(case_id, document_id)], LINKS)
            self._write("links", catalog.add_to_case(self._read("links", LINKS), self._read("cases", CASES), new)[0])
        return self.case(case_id)

    def remove_from_case(self, case_id: str, document_id: str) -> dict:
        self.case(case_id)
        with self.lock:
            gone = self.spark.createDataFrame([(case_id, document_id)], LINKS)
            self._write("links", catalog.remove_from_case(self._read("links", LINKS), gone))
        return self.case(case_id)

    def _found(self, chunks: DataFrame, asked: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
        """Gated hybrid results with the chunks' columns."""
        asked = retrieve.answerable(asked)
        hits = bm25.search(self._index(self.method), asked, 2 * k, scope=scope)
        near = knn.block_top_k(chunks.select("chunk_id", "vector"), asked.withColumn("vector", self.embed(F.col("query"))), 2 * k, scope=scope, least=0.3)
        return fusion.gate(fusion.fuse(near, hits, k), self.threshold).join(chunks.drop("vector"), "chunk_id")

    def query(self, question: str, k: int = 8, case_id: str | None = None, filters: dict | None = None) -> dict:
        """Sources, and an answer with its citations if a model is configured; refused where nothing is found.

        filters: document_ids, of which an empty list finds nothing; other keys are refused.
        """
        retrieve.checked(question)
        ids = retrieve.document_filter(filters)
        none = {"refused": True, "answer": generation.REFUSAL, "citations": [], "trace": []}
        chunks = self._chunks(self.method)
        if chunks is None:
            return none
        scope = None
        if case_id is not None:
            of_case = F.col("case_id") == case_id
            if self._read("cases", CASES).filter(of_case).isEmpty():
                raise NotFound(case_id)
            docs = self._read("links", LINKS).filter(of_case)
            if docs.isEmpty():
                return none | {"reason": "empty_case"}
            scope = chunks.join(docs, "document_id", "left_semi").select("chunk_id")
        if ids is not None:
            wanted = self.spark.createDataFrame([(i,) for i in ids], "document_id string")
            named = chunks.join(wanted, "document_id", "left_semi").select("chunk_id")
            scope = named if scope is None else scope.join(named, "chunk_id", "left_semi")
        asked = self.spark.createDataFrame([("q", question)], "query_id string, query string")
        packed = generation.pack(self._found(chunks, asked, k, scope).withColumn("question_id", F.col("query_id"))).persist()
        trace = [r.asDict() for r in generation.trace(packed).orderBy("rank").collect()]
        if not trace:
            return none
        if self.answer is None:
            return {"refused": False, "answer": None, "citations": [], "trace": trace}
        prompts = generation.prompts(asked.select(F.col("query_id").alias("question_id"), F.col("query").alias("question")), generation.contexts(packed), INSTRUCTIONS)
        answers = generation.generate(prompts, self.answer).persist()
        cited = generation.citations(answers, packed)
        status = generation.answer_status(answers, cited, packed).first()
        if status["status"].startswith("error"):
            raise RuntimeError(status["status"])
        return {"refused": False, "answer": status["answer"], "citations": [r.asDict() for r in cited.filter("resolved").orderBy("place").collect()], "trace": trace}

    def evaluate(self, dataset: str, k: int = 5) -> str:
        """Starts a run over a dataset file and returns its id; runs go one at a time."""
        run = uuid.uuid4().hex
        self.runs[run] = {"id": run, "status": "pending"}

        def work() -> None:
            with self.lock:
                self.runs[run]["status"] = "running"
                try:
                    raw = documents.evaluation_questions(self.spark, dataset).withColumns({"query_id": F.col("id"), "query": F.col("question")})
                    chunks = self._chunks(self.method)
                    cases = evaluation.score_cases(raw, self._found(chunks, raw.select("query_id", "query"), k), evaluation.ground_truth(evaluation.parsed_questions(raw), chunks)).persist()
                    summary = evaluation.summarise(cases, ["recall_at_1", "recall_at_3", "recall_at_5", "precision_at_5", "reciprocal_rank"])
                    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
                    documents.write_run(summary, cases, self._path("runs"), f"{stamp}-{run[:8]}", {"dataset": dataset, "method": self.method, "top_k": str(k)})
                    self.runs[run] |= {"status": "done", "summary": [r.asDict() for r in summary.collect()]}
                except Exception as e:  # the caller polls for it
                    self.runs[run] |= {"status": "failed", "error": str(e)[:500]}

        threading.Thread(target=work, daemon=True).start()
        return run

    def evaluation_run(self, run: str) -> dict:
        if run not in self.runs:
            raise NotFound(run)
        return self.runs[run]

    def evaluation_runs(self) -> list[dict]:
        try:
            return [r.asDict() for r in documents.list_runs(self.spark, self._path("runs")).collect()]
        except AnalysisException:
            return []


def routed(service: Service, verb: str, path: str, body: dict) -> tuple[int, object]:
    """A request's status and reply."""
    parts = [p for p in path.split("?")[0].split("/") if p]
    try:
        match (verb, *parts):
            case ("GET", "health"):
                return 200, service.health()
            case ("GET", "documents"):
                return 200, service.documents()
            case ("DELETE", "documents", doc):
                return 200, {"deleted": service.delete_document(doc)}
            case ("POST", "query"):
                return 200, service.query(body.get("question", ""), int(body.get("top_k", 8)), body.get("case_id"), body.get("filters"))
            case ("POST", "ingest"):
                done = service.ingest([(f["filename"], bytes.fromhex(f["content_hex"])) for f in body["files"]], body.get("category"))
                return (400 if all(r["error"] for r in done) else 200), done
            case ("POST", "cases"):
                return 200, service.create_case(body["name"], body.get("description"))
            case ("GET", "cases"):
                return 200, service.cases()
            case ("GET", "cases", case):
                return 200, service.case(case)
            case ("POST", "cases", case, "documents"):
                return 200, service.add_to_case(case, body["document_id"])
            case ("DELETE", "cases", case, "documents", doc):
                return 200, service.remove_from_case(case, doc)
            case ("POST", "evaluate"):
                return 202, {"id": service.evaluate(body["dataset"])}
            case ("GET", "evaluate", "runs"):
                return 200, service.evaluation_runs()
            case ("GET", "evaluate", run):
                return 200, service.evaluation_run(run)
        return 404, {"error": "no such route"}
    except NotFound as e:
        return 404, {"error": f"{e} is unknown"}
    except (ValueError, KeyError, NotImplementedError) as e:
        return 400, {"error": str(e)}
    except RuntimeError as e:
        return 502, {"error": str(e)}


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    """A server for routed; the caller runs serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                status, reply = routed(service, self.command, self.path, body)
            except json.JSONDecodeError:
                status, reply = 400, {"error": "the body is no JSON"}
            raw = json.dumps(reply, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = _reply

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
