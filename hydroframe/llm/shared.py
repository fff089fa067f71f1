"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that part words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Texts are worked on in portions of so many bytes, whatever a batch holds.
PORTION = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of a written table are of no more use; with this Spark drops them when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="hydroframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/hydroframe"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until release() or until the owner of the folder clears it.
    """
    spark = df.sparkSession
    root = shared_root(spark)
    database = f"hydroframe_{blake2b(root.encode(), digest_size=6).hexdigest()}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION {root!r}")
    name = f"{database}.{label.replace('-', '_')}_{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.format("parquet").saveAsTable(name)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    out = spark.table(name)
    out.scratch_table = name
    return out


def release(*written: DataFrame) -> None:
    """Drop tables of materialize() that nothing reads any more."""
    for df in written:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.scratch_table} PURGE")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold a few megabytes, so that long rows don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * PORTION))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def portions(texts: pa.Array, limit: int = PORTION) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` bytes together, one text at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, stop
        at = stop


def text_of(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, runs of characters other than the six blanks; none for an empty text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
