"""Packing token sequences into fixed windows, best fit decreasing.

Documents are tokenised where they lie; overlong ones are cut into full windows. Pieces are then dealt
by a hash into groups of about ``group_pieces``, so that memory is bounded and the padding that each
group leaves stays a small share, and every group is packed by best fit decreasing: a segment tree
indexed by remaining capacity finds the tightest open window.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, materialise, per_process, small_batches
from .vectext import slices

# The word pattern of byte-level BPE.
PIECES, AHEAD, SPACE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|", r"\s+(?!\S)|", r"\s+"
_RUN = re.compile(r"\s\s")


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Strings and ids of the tokens that a tokenizers file finds in a text before anything else."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}


def byte_ranks(tokenizer_path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE in a tokenizers file; ids order its merges."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    to_byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


class ByteEncoder:
    """Token ids as the tokenizers library gives them for the same file, by a faster encoder.

    With added, the strings of added tokens are those tokens, as tokenizers has it by default; else they
    are ordinary text, as it has it with encode_special_tokens. The look-ahead of the pattern matters only where two
    white-space characters meet; texts without such a place are cut by the plain pattern.
    """

    def __init__(self, tokenizer_path: str, *, added: bool = False):
        import tiktoken

        self.added = added_tokens(tokenizer_path) if added else {}
        # Of tokens that begin at one place the longest is found.
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        ranks = byte_ranks(tokenizer_path)
        self.full, self.simple = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("full", PIECES + AHEAD + SPACE), ("simple", PIECES + SPACE)))

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.split is None or not any(x in text for x in self.added):
            return self._plain(text)
        parts = [np.array([self.added[x]], np.int32) if i % 2 else self._plain(x) for i, x in enumerate(self.split.split(text))]
        return np.concatenate(parts)

    def _plain(self, text: str) -> np.ndarray:
        return np.array((self.full if _RUN.search(text) else self.simple).encode_ordinary(text), np.int32)


def cut(tokenizer_path: str, window: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_doc, _text) -> pieces of at most window ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = per_process(("encoder", tokenizer_path), lambda: ByteEncoder(tokenizer_path, added=True)), 0
        for batch in (x for y in batches for x in slices(y, "_text")):
            out: dict[str, list] = {x: [] for x in ("doc", "start", "length", "crc", "tokens", "salt", "ids")}
            for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("_text")):
                ids = np.append(encoder.encode(text.as_py()), np.int32(end_id)).astype("<u4")
                row += 1
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    out["doc"].append(doc)
                    out["start"].append(start)
                    out["length"].append(len(piece))
                    out["crc"].append(zlib.crc32(piece.tobytes()))
                    out["tokens"].append(len(ids))
                    out["salt"].append(row)
                    out["ids"].append(piece.astype(np.int32))
            cols = [pa.array(out[x], pa.int64()) for x in ("doc", "start", "length", "crc", "tokens", "salt")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_salt"]
            if with_ids:
                cols, names = [*cols, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree whose nodes count them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of need or more, and that capacity."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For lengths in falling order the window and the offset in it of each."""
    open_, where, offsets, new = OpenWindows(window), [], [], 0
    for n in lengths:
        found = open_.take(n)
        if found is None:
            found, new = (new, window), new + 1
        where.append(found[0])
        offsets.append(window - found[1])
        open_.put(found[1] - n, found[0])
    return where, offsets


def pack_documents(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    window: int = 2048,
    end_id: int = 1,
    group_pieces: int = 4000,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Every document ends with end_id, so a null or empty text is one piece of one id. Repeated rows are
    packed as often as they occur. Other columns of docs are not carried. Empty table, empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    c = Carried(docs, doc=id_col, text=text_col)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _salt long" + ", ids array<int>" * with_ids
    pieces = materialise(
        c.df.select(c.col("doc").cast("long").alias("_doc"), c.col("text").alias("_text")).mapInArrow(cut(tokenizer_path, window, end_id, with_ids), schema),
        "pieces",
    )
    groups = max(1, -(-pieces.count() // group_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] * with_ids)]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offsets = best_fit_decreasing(table.column("length").to_pylist(), window)
        group = table.column("_group")[0].as_py()
        table = table.append_column("sequence_id", pa.array((np.int64(group) << 32) + np.array(where, np.int64)))
        return table.append_column("offset", pa.array(offsets, pa.int64())).select(names)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_salt"), F.lit(groups)))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return dealt.groupBy("_group").applyInArrow(pack, out)
