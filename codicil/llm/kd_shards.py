"""Sharding by a k-d tree over document metadata, DataFrame functions only.

Texts that are equal form one unit and stay in one shard. A node of the tree is split at the weighted
median (bytes) along its widest metadata dimension, until there are as many leaves as shards. Medians
are found by distributed radix selection: each pass sums bytes per node and digit, and only such sums,
256 a node, reach the driver. Ties of a coordinate are ordered by the text's hash, so a median can fall
inside a value that a third of all rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, materialise

#: Coordinates are scaled to 24 bits; 24 bits of the text's hash order what is equal.
BITS, DIGIT = 24, 8


def _prefix_number(c: Column) -> Column:
    """The first six bytes of a string as a number that orders as the string does; null is -1."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(c.cast("string").cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def _by_node(values: dict[int, object]) -> Column:
    """A value looked up by node number."""
    out = F.lit(None)
    for node, v in values.items():
        out = F.when(F.col("_node") == node, F.lit(v)).otherwise(out)
    return out


def split(units: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """units (_h1, _bytes and coordinates) -> also _leaf. Each unit goes whole into one leaf."""
    widest = units.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]).first()
    whole = {d: (widest[f"min_{d}"] or 0.0, max((widest[f"max_{d}"] or 0.0) - (widest[f"min_{d}"] or 0.0), 1e-9)) for d in dims}
    scaled = units
    for d, (low, wide) in whole.items():
        scaled = scaled.withColumn(f"_s{d}", F.floor((F.col(d) - low) / wide * ((1 << BITS) - 1)).cast("long"))
    salt = F.shiftrightunsigned("_h1", 64 - BITS)
    # node -> (first leaf, leaves); column _node is the first leaf of the node that a unit is in.
    state, nodes = materialise(scaled.withColumn("_node", F.lit(0)), "kd"), {0: leaves}
    while any(k > 1 for k in nodes.values()):
        open_ = [n for n, k in nodes.items() if k > 1]
        spans = state.groupBy("_node").agg(*[f(f"_s{d}").alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]).collect()
        axis = {r["_node"]: max(dims, key=lambda d, r=r: (r[f"max_{d}"] - r[f"min_{d}"], d)) for r in spans}
        coordinate = F.lit(None).cast("long")
        for d in dims:
            on = [n for n, a in axis.items() if a == d]
            if on:
                coordinate = F.when(F.col("_node").isin(on), F.col(f"_s{d}")).otherwise(coordinate)
        keyed = state.withColumn("_key", F.shiftleft(coordinate, BITS).bitwiseOR(salt))
        # Radix selection: below[n] is the weight under the prefix that holds the median, found[n] the prefix.
        live = [n for n in open_ if n in axis]
        found, below, total = {n: 0 for n in live}, {n: 0 for n in live}, {}
        for at in range(2 * BITS - DIGIT, -1, -DIGIT):
            here = keyed.filter(F.col("_node").isin(live))
            if at < 2 * BITS - DIGIT:
                here = here.filter(F.shiftright("_key", at + DIGIT) == _by_node(found).cast("long"))
            sums: dict[int, list[tuple[int, int]]] = {}
            for r in here.groupBy("_node", F.shiftright("_key", at).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("d")).agg(F.sum("_bytes").alias("w")).collect():
                sums.setdefault(r["_node"], []).append((r["d"], r["w"]))
            for n in live:
                cells = sorted(sums[n])
                if n not in total:
                    total[n] = sum(w for _, w in cells)
                goal = total[n] * (nodes[n] // 2) / nodes[n]
                for d, w in cells:
                    # The median's cell is the one that the goal falls into; the last cell takes what is left.
                    if below[n] + w >= goal or d == cells[-1][0]:
                        found[n] = (found[n] << DIGIT) | int(d)
                        break
                    below[n] += w
        # Up to the median's key goes left, if that is nearer the goal than what is under the key alone.
        last = {r["_node"]: r["w"] for r in keyed.filter(F.col("_node").isin(live)).filter(F.col("_key") == _by_node(found).cast("long")).groupBy("_node").agg(F.sum("_bytes").alias("w")).collect()}
        bound = {}
        for n in live:
            goal = total[n] * (nodes[n] // 2) / nodes[n]
            bound[n] = found[n] if abs(below[n] + last[n] - goal) <= abs(below[n] - goal) else found[n] - 1
        halves = {n: nodes[n] // 2 for n in live}
        move = F.when(F.col("_key") > _by_node(bound).cast("long"), _by_node(halves).cast("int")).otherwise(F.lit(0)) if live else F.lit(0)
        state = materialise(keyed.withColumn("_node", (F.col("_node") + F.coalesce(move, F.lit(0))).cast("int")).drop("_key"), "kd")
        nodes = {m: k for n, all_ in nodes.items() for m, k in (((n, all_ // 2), (n + all_ // 2, all_ - all_ // 2)) if all_ > 1 else ((n, all_),))}
    return state.withColumnRenamed("_node", "_leaf")


def shard_documents(
    docs: DataFrame, *, shards: int = 16, slot_cells: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Returns the rows of docs with size, text_crc32, shard and slot (gapless from 0 in each shard).

    Shards have nearly equal bytes, as far as groups of equal texts allow: those stay together. Null text is
    as the empty text; each row weighs its bytes plus 1, so that empty texts are spread too. Repeated rows
    are separate rows of one group. Null languages and sources come first. An empty table stays empty.
    Columns with the names of the new ones are replaced.
    """
    c = Carried(docs, doc=id_col, text=text_col, lang=lang_col, source=source_col)
    text = F.coalesce(c.col("text"), F.lit(""))
    base = (
        c.df.withColumn("_size", (F.octet_length(text) + 1).cast("long"))
        .withColumn("_crc", F.crc32(text.cast("binary")))
        .withColumn("_h1", F.xxhash64(text))
        .withColumn("_h2", F.xxhash64(F.lit(3), text))
    )
    units = (
        base.groupBy("_h1", "_h2")
        .agg(
            F.sum("_size").alias("_bytes"),
            F.log2(F.max("_size") + 1.0).alias("length"),
            F.min(_prefix_number(c.col("lang"))).alias("lang"),
            F.min(_prefix_number(c.col("source"))).alias("source"),
            F.coalesce(F.min(c.col("doc")).cast("double"), F.lit(-1.0)).alias("id"),
        )
    )
    leaves = split(materialise(units, "units"), ["length", "lang", "source", "id"], shards).select("_h1", "_h2", F.col("_leaf").alias("_shard"))
    placed = base.join(leaves, ["_h1", "_h2"]).withColumn("_cell", F.pmod(F.xxhash64(c.col("doc"), "_h1"), F.lit(slot_cells)))
    # Slots: rows of a shard are numbered by cells of it, so that no task holds a shard.
    cells = placed.groupBy("_shard", "_cell").agg(F.count(F.lit(1)).alias("_k"))
    starts = cells.select("_shard", "_cell", (F.sum("_k").over(Window.partitionBy("_shard").orderBy("_cell")) - F.col("_k")).alias("_start"))
    slot = F.row_number().over(Window.partitionBy("_shard", "_cell").orderBy(c.col("doc"), "_h1", "_h2")) - 1
    numbered = placed.withColumn("_in", slot).join(starts, ["_shard", "_cell"])
    return c.restore(
        numbered,
        {
            "size": F.col("_size"),
            "text_crc32": F.col("_crc"),
            "shard": F.col("_shard").cast("int"),
            "slot": (F.col("_start") + F.col("_in")).cast("long"),
        },
    )
