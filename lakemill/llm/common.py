"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import delete, shared_folder
from ..operators.tables import drop as discard  # noqa: F401  for the operators beside this module

#: The words of every contract here: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Where set, Spark deletes the exchange files of an action when it ends; the tables that materialise() writes need none of them.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folder, below the shared one, of the tables of the scratch() that surrounds a call.
_scratch: ContextVar[str] = ContextVar("scratch", default="")


@contextmanager
def scratch(spark: SparkSession):
    """Tables that materialise() writes meanwhile, in this thread, are deleted at the end."""
    inner = f"{_scratch.get()}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(inner)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, shared_folder(spark) + inner)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}{_scratch.get()}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None, advisory: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage ends, no executor is needed. advisory is the
    size of a partition at which AQE splits and joins them, batch_rows the rows of an Arrow batch, where the session's own don't suit:
    batches of texts take memory on both sides."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    wanted = {FREES: "true"} | ({ADVISORY: advisory} if advisory else {}) | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs with columns column0, column1 and so on, the new name of each old one, and what puts the old ones back:
    no column of the input can then clash with one that an operator adds."""
    names = {c: f"column{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda df: df.select(*[df[new].alias(old) for old, new in names.items()])


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")))


def pieces(batches, limit: int = 16_000_000):
    """Splits record batches so that one piece has at most about limit bytes (or a single row)."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
