"""Shared helpers: work folder, materialised tables, joins with hot keys, word hashing and held-out rows."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot from this share of all rows on, and from this number of rows.
HOT_BITS, HOT_ROWS = 16, 1024


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder; on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="urlloom-"))
        base = _fallback[0]
    return f"{base.rstrip('/')}/urlloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    The shuffle files behind it go as soon as it is written; ``discard`` drops the table.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for table in tables:
        if path := _paths.pop(table, None):
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def meet(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join of ``rows`` with ``table`` that no hot key can hold up.

    ``table`` has one row a key, with the number ``n`` of rows that will meet it, ``total`` of
    them in all. The keys with more than total / 2 ** HOT_BITS rows (at least HOT_ROWS) number
    at most 2 ** HOT_BITS, so they are broadcast; the others meet in a shuffle, in which none
    holds more than that share. Null keys meet nothing.
    """
    least = max(HOT_ROWS, total >> HOT_BITS)
    hot, cold = (F.broadcast(table.filter(F.col(n) > least)), table.filter(F.col(n) <= least))
    return rows.join(hot, on).union(rows.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def minus(docs: DataFrame, gone: DataFrame, *, doc_id: str, text: str | None = None, limit: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose id (and text) is not in ``gone``, with all columns as they are.

    ``gone`` is a written table of ``_gone`` and, with ``text``, ``_text`` (xxhash64 of the text); nulls are
    equal. If it has at most ``limit`` rows, which is counted first, it is broadcast; beyond
    that, rows are dealt by id.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    same = F.col(f"_row.`{doc_id}`").cast("long").eqNullSafe(F.col("_gone"))
    if text is not None:
        same &= F.xxhash64(F.col(f"_row.`{text}`")) == F.col("_text")
    gone = F.broadcast(gone) if gone.limit(limit + 1).count() <= limit else gone.hint("shuffle_hash")
    return row.join(gone, same, "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows kept out of training; a null id counts as a training row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of the splitmix generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows, so that only a piece's Python objects exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def column_bytes(batch, name: str) -> list[bytes]:
    """Values of a string column of an Arrow batch as UTF-8; null gives empty."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
