"""Helpers shared by the corpus operators: column carrying, shared-folder tables, text rules."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the contracts: white space between words, and the letters that are lower-cased.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


class Carried:
    """A DataFrame whose columns got positional names, so that nothing an operator adds can clash with them.

    Roles name the columns that the operator needs; a role's column is found by exact name first, then
    without regard to case. ``restore`` gives the old names back and appends the operator's own columns,
    which replace input columns of the same name.
    """

    def __init__(self, df: DataFrame, **roles: str):
        self.names = list(df.columns)
        self.df = df.toDF(*[f"_c{i}" for i in range(len(self.names))])
        self.at = {role: f"_c{self._find(name)}" for role, name in roles.items()}

    def _find(self, name: str) -> int:
        if name in self.names:
            return self.names.index(name)
        lowered = [n.lower() for n in self.names]
        if name.lower() in lowered:
            return lowered.index(name.lower())
        raise ValueError(f"column {name} is missing; there are {self.names}")

    def col(self, role: str) -> Column:
        return F.col(self.at[role])

    def restore(self, df: DataFrame, new: dict[str, Column] | None = None, instead: dict[str, Column] | None = None) -> DataFrame:
        """new: columns to append; instead: role -> column that takes the place of that role's input column."""
        new, swapped = new or {}, {self.at[r]: c for r, c in (instead or {}).items()}
        taken = {n.lower() for n in new}
        cols = [
            swapped.get(f"_c{i}", F.col(f"_c{i}")).alias(n)
            for i, n in enumerate(self.names)
            if n.lower() not in taken
        ]
        return df.select(*cols, *[c.alias(n) for n, c in new.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset, a local session (tests) gets a temporary folder and any other session a folder
    in the warehouse, which a cluster shares as well.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.startswith("local["):
            at = "file://" + tempfile.mkdtemp(prefix="codicil-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_codicil"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codicil/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITE + "+"), "")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches that hold few rows, as one row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def per_process(key: Hashable, make: Callable[[], object]) -> object:
    """What make gives, made once in each Python process and kept from task to task."""
    store = sys.modules.setdefault("_codicil_kept", types.ModuleType("_codicil_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def lowest_hashes(key: Column, rows: int, wanted: int) -> Column:
    """Holds for keys of so low hashes that somewhat more than wanted of rows keys are expected to be among them.

    Taken before a sort by hash with a limit, it keeps what each task hands on bounded, and the result as it is.
    """
    share = min(1.0, (1.2 * wanted + 1000) / max(rows, 1))
    return F.xxhash64(key) <= F.lit(int(min((2 * share - 1) * 2.0**63, 2.0**63 - 1025)))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df marked to be sent to all tasks if it has at most ``most`` rows; else as it is, for a join by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
