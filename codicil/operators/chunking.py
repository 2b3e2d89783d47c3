"""Three ways to cut documents into chunks, behind one signature: pages -> chunks.

Where a cut depends on all cuts before it, the arithmetic is a small Python function over one document
(or one group of paragraphs), run on Arrow batches; everything around it is DataFrame work.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.sections import parsed
from codicil.functions.text import has_alnum, strip
from codicil.operators.structure import islands, paragraphs

SENTENCE = re.compile(r"(?<=[.!?])\s+")
SEPARATORS = ("\n\n", "\n", ". ", " ")
PIECES = "pieces array<struct<text string, page_number int, end_page_number int>>"


def with_overlap(texts: list[str], size: int) -> list[str]:
    """Each text but the first led by the end of the one before, from that end's first space on."""
    out = texts[:1]
    for before, text in zip(texts, texts[1:]):
        tail = before[-size:] if size > 0 else ""
        tail = tail.split(" ", 1)[-1]
        out.append(f"{tail} {text}".strip() if tail else text)
    return out


def by_size(text: str, size: int) -> list[str]:
    """Cuts of at most size characters, at the last space where there is one."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.rfind(" ", at, end)
            end = space if space > at else end
        out.append(text[at:end].strip())
        at = end
    return [x for x in out if x]


def by_sentence(text: str, target: int, most: int) -> list[str]:
    """Sentences packed up to target characters; one longer than most is cut by size."""
    out: list[str] = []
    open_ = False  # whether the last piece may still grow
    for sentence in filter(None, map(str.strip, SENTENCE.split(text))):
        if len(sentence) > most:
            out += by_size(sentence, target)
            open_ = False
        elif open_ and len(out[-1]) + 1 + len(sentence) <= target:
            out[-1] += " " + sentence
        else:
            out.append(sentence)
            open_ = True
    return out or by_size(text, target)


def pack_paragraphs(group: list[tuple[str, int, int]], *, target: int, most: int, least: int, overlap: int) -> list[tuple[str, int, int]]:
    """Paragraphs (text, page, end page) of one heading -> pieces: filled up to target, never beyond most but for the overlap."""
    pieces: list[list] = []
    room = 0  # what the last piece can still take; 0 closes it
    for text, page, end in group:
        if len(text) > most:
            pieces += [[part, page, end] for part in by_sentence(text, target, most)]
            room = 0
        elif len(text) + 2 <= room:
            pieces[-1] = [pieces[-1][0] + "\n\n" + text, pieces[-1][1], end]
            room -= len(text) + 2
        else:
            pieces.append([text, page, end])
            room = target - len(text)
    folded: list[list] = []
    for text, page, end in pieces:
        if folded and len(text) < least and len(folded[-1][0]) + 2 + len(text) <= most:
            folded[-1] = [folded[-1][0] + "\n\n" + text, folded[-1][1], end]
        else:
            folded.append([text, page, end])
    return [(t, p, e) for t, (_, p, e) in zip(with_overlap([x[0] for x in folded], overlap), folded)]


def cut_points(text: str, begin: int, end: int, size: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of text[begin:end] of at most size characters, each ending after a separator, the coarsest that does."""
    if end - begin <= size:
        return [(begin, end)] if end > begin else []
    if not separators:
        return [(i, min(i + size, end)) for i in range(begin, end, size)]
    sep, finer = separators[0], separators[1:]
    out: list[tuple[int, int]] = []
    start = at = begin
    while at < end:
        found = text.find(sep, at, end)
        stop = end if found < 0 else found + len(sep)
        if stop - start > size and at > start:
            out.append((start, at))
            start = at
        if stop - at > size:
            out += cut_points(text, at, stop, size, finer)
            start = stop
        at = stop
    if at > start:
        out.append((start, at))
    return [(a, b) for a, b in out if text[a:b].strip()]


def recursive_pieces(pages: list[tuple[int, str]], *, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[str, int, int]]:
    text = "\n\n".join(t for _, t in pages)
    starts, ends, at = [], [], 0
    for _, t in pages:
        starts.append(at)
        ends.append(at + len(t))
        at = ends[-1] + 2
    spans = cut_points(text, 0, len(text), size, separators) if text.strip() else []
    out = []
    for piece, (a, b) in zip(with_overlap([text[a:b] for a, b in spans], overlap), spans):
        on = [i for i in range(bisect_right(ends, a), bisect_left(starts, b)) if ends[i] > starts[i]]
        # A piece between two pages is of the page before.
        first, last = (on[0], on[-1]) if on else (max(bisect_right(starts, a) - 1, 0),) * 2
        out.append((piece, pages[first][0], pages[last][0]))
    return out


def fold_text(text: str) -> tuple[str, list[int]]:
    """Plain quotes and dashes, one space for a run of white space, lower case; and where each character was."""
    plain = str.maketrans("‘’“”–—�", "''\"\"--'")
    out, at = [], []
    for i, c in enumerate(text.translate(plain)):
        if not (c.isspace() and out and out[-1] == " "):
            c = " " if c.isspace() else c
            for low in c.lower():
                out.append(low)
                at.append(i)
    return "".join(out), at


def anchored_pieces(text: str, anchors: list[str], lines: bool = False) -> tuple[list[str], int]:
    """The text cut where the anchors are found, each after the one before; and how many were not found.

    lines: an anchor counts as found only where a line begins, white space before it aside.
    """
    folded, at = fold_text(text)
    begins = [bisect_left(at, m.end()) for m in re.finditer(r"(?:\A|\n)\s*", text)] if lines else []
    cuts: list[int] = []
    skipped = 0
    for anchor in anchors:
        wanted = fold_text(anchor)[0].strip()
        begin = bisect_left(at, cuts[-1] + 1) if cuts else 0
        if lines:
            found = next((i for i in begins[bisect_left(begins, begin) :] if folded.startswith(wanted, i)), -1) if wanted else -1
        else:
            found = folded.find(wanted, begin) if wanted else -1
        if found < 0 or (cuts and at[found] <= cuts[-1]):
            skipped += 1
        else:
            cuts.append(at[found])
    edges = [*([0] if not cuts or cuts[0] else []), *cuts, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:])], skipped


def _each(df: DataFrame, column: str, f: Callable[[list], list]) -> DataFrame:
    """Adds pieces = f(row's array of structs, as tuples)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("page_number", pa.int32()), ("end_page_number", pa.int32())]))
        for batch in batches:
            rows = [[dict(zip(("text", "page_number", "end_page_number"), p)) for p in f([tuple(x.values()) for x in value])] for value in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*names, "pieces"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + PIECES)


def _numbered(pieces: DataFrame, order: list[str | Column]) -> DataFrame:
    """Pieces with a letter or digit, numbered densely per document, as chunks."""
    live = pieces.withColumn("text", strip(F.col("text"))).filter(has_alnum(F.col("text")))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(*order)) - 1
    return live.withColumn("chunk_id", F.format_string("%s:%04d", F.col("document_id"), n))


CHUNK = ("chunk_id", "document_id", "page_number", "end_page_number", "section", "heading", "text", "document_name", "category", "section_number", "subsection", "clause", "structure_path")


def _plain_chunks(numbered: DataFrame) -> DataFrame:
    null = {c: F.lit(None).cast("string") for c in ("section", "heading", "section_number", "subsection", "clause")}
    return numbered.withColumns(null | {"structure_path": F.lit(None).cast("array<string>")}).select(*CHUNK)


def _pages(pages: DataFrame) -> DataFrame:
    """Page text with the optional columns."""
    for c in ("filename", "category"):
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(None).cast("string"))
    return pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("page_number", F.col("page_number").cast("int"))


def _per_document(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_pages"), F.min_by("filename", "page_number").alias("document_name"), F.any_value("category").alias("category")
    )


def chunk_legal(pages: DataFrame, *, target: int = 1200, most: int = 1600, overlap: int = 150, least: int = 40) -> DataFrame:
    """Chunks along headings and sections."""
    pages = _pages(pages)
    grouped = (
        islands(paragraphs(pages), ["document_id"], ["para"], ["heading", "section"])
        .groupBy("document_id", "island", "heading", "section")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("para", "text", "page_number", "end_page_number"))), lambda p: F.struct(p["text"].alias("text"), p["page_number"].alias("a"), p["end_page_number"].alias("b"))).alias("_paras"))
    )
    cut = _each(grouped, "_paras", lambda rows: pack_paragraphs(rows, target=target, most=most, least=least, overlap=overlap))
    pieces = cut.select("document_id", "island", "heading", "section", F.posexplode("pieces").alias("_at", "_p")).select("document_id", "island", "heading", "section", "_at", "_p.*")
    names = pages.groupBy("document_id").agg(F.min_by("filename", "page_number").alias("document_name"), F.any_value("category").alias("category"))
    return _numbered(pieces, ["island", "_at"]).join(names, "document_id").withColumn("_s", parsed(F.col("section"))).select(
        *CHUNK[:9], "_s.section_number", "_s.subsection", "_s.clause", F.when(F.size("_s.structure_path") > 0, F.col("_s.structure_path")).alias("structure_path")
    )


def chunk_recursive(pages: DataFrame, *, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks of bounded size at the coarsest separators; pages are told from the offsets."""
    cut = _each(_per_document(_pages(pages)), "_pages", lambda rows: recursive_pieces(rows, size=size, overlap=overlap))
    pieces = cut.select("document_id", "document_name", "category", F.posexplode("pieces").alias("_at", "_p")).select("document_id", "document_name", "category", "_at", "_p.*")
    return _plain_chunks(_numbered(pieces, ["_at"]))


def chunk_semantic(pages: DataFrame, anchors: DataFrame, *, window: int = 3, budget: float = 0.05, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks at proposed anchors, and the documents that are turned away.

    anchors (document_id, window_index, anchors array<string>): for each window of pages the beginnings of
    its chunks; a window without a row is one chunk. A document of whose anchors more than ``budget`` can't
    be found in order is turned away whole: it has a row in the second result and no chunks. With ``lines``
    anchors are looked for only where lines begin.
    """
    ordered = Window.partitionBy("document_id").orderBy("page_number")
    windows = (
        _pages(pages)
        .withColumn("window_index", F.floor((F.row_number().over(ordered) - 1) / window).cast("int"))
        .groupBy("document_id", "window_index")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n\n").alias("_text"),
            F.min("page_number").alias("page_number"),
            F.max("page_number").alias("end_page_number"),
            F.min_by("filename", "page_number").alias("document_name"),
            F.any_value("category").alias("category"),
        )
        .filter(strip(F.col("_text")) != "")
        .join(anchors.select("document_id", F.col("window_index").cast("int").alias("window_index"), "anchors"), ["document_id", "window_index"], "left")
        .withColumn("_anchors", F.coalesce("anchors", F.array().cast("array<string>")))
        .drop("anchors")
    )
    names = windows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchored_pieces(t, a, lines) for t, a in zip(batch.column("_text").to_pylist(), batch.column("_anchors").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.int32())], [*names, "_pieces", "_skipped"])

    cut = windows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema) + ", _pieces array<string>, _skipped int")
    told = cut.groupBy("document_id").agg(F.sum(F.size("_anchors")).alias("anchors"), F.sum("_skipped").alias("skipped"))
    rejected = told.filter((F.col("anchors") > 0) & (F.col("skipped") > budget * F.col("anchors")))
    pieces = cut.join(rejected.select("document_id"), "document_id", "left_anti").select(
        "document_id", "document_name", "category", "page_number", "end_page_number", "window_index", F.posexplode("_pieces").alias("_at", "text")
    )
    return _plain_chunks(_numbered(pieces, ["window_index", "_at"])), rejected


METHODS: dict[str, Callable[..., DataFrame]] = {
    "legal": chunk_legal,
    "recursive": chunk_recursive,
    "llm_semantic": lambda pages, anchors, **kw: chunk_semantic(pages, anchors, **kw)[0],
}


def chunk(pages: DataFrame, method: str = "legal", **options) -> DataFrame:
    """Cuts pages by the named method; llm_semantic needs anchors."""
    if method not in METHODS:
        raise ValueError(f"chunking method {method} is none of {', '.join(METHODS)}")
    if method == "llm_semantic" and "anchors" not in options:
        raise ValueError("llm_semantic needs anchors")
    return METHODS[method](pages, **options)


def overlapped(rows: DataFrame, by: list[str], order: list[str], *, size: int = 150, text_col: str = "text") -> DataFrame:
    """The overlap alone, as a window: each row's text led by the end of the row before, from that end's first space on."""
    before = F.lag(text_col).over(Window.partitionBy(*by).orderBy(*order))
    tail = F.right(before, F.lit(size))
    at = F.locate(" ", tail)
    lead = F.when(at > 0, F.substring(tail, at + 1, F.length(tail))).otherwise(tail)
    return rows.withColumn(text_col, F.when(F.coalesce(lead, F.lit("")) != "", strip(F.concat(lead, F.lit(" "), text_col))).otherwise(F.col(text_col)))
