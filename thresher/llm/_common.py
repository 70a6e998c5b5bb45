"""Shared plumbing of the training-data operators: shared scratch space, files, Arrow UDFs."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder URI under the session's ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) is a folder of our own
    used; it is then also made the session's checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if "dir" not in _OWN_DIR:
            _OWN_DIR["dir"] = "file://" + tempfile.mkdtemp(prefix="thresher-")
        base = _OWN_DIR["dir"]
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_least_hash(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """(h, t) of texts whose hashes lie in the share of all hashes that holds about ``rows`` rows: a draw that
    is the same in every run and needs neither a sort nor a shuffle."""
    n = docs.count()
    edge = (2**64 - 1) * min(n, rows) // max(n, 1) - 2**63
    return docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).where((F.col("h") <= edge) & F.col("t").isNotNull())


#: A table of at most so many rows is broadcast; what is larger is joined by shuffle.
BROADCAST_ROWS = 200_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, n_col: str, total: int, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with ``table`` (one row a non-null ``key``; ``n_col`` counts the rows that have it, ``total`` in all).

    A small table is broadcast. Of a larger one only keys that hold over 1/4096 of all rows are, so
    that no key that is dealt out is hot; the others meet their rows by shuffle."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), key, how)
    edge = total / 4096
    hot = F.broadcast(table.where(F.col(n_col) > edge))
    names = F.broadcast(table.where(F.col(n_col) > edge).select(key))
    met = rows.join(hot, key)
    rest = rows.join(names, key, "left_anti").join(table.where(F.col(n_col) <= edge), key, how)
    return met.unionByName(rest.select(met.columns))


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system layer."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def open_fs(uri: str):
    """(pyarrow file system, path) for a URI of the shared folder; used on executors."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else uri
    return fs.FileSystem.from_uri(uri)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trainable(id_col: str | Column = "doc_id") -> Column:
    """Rows that a model may learn from: id present and not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return c.isNotNull() & ~held_out(c)


def release() -> None:
    """Give memory that is free back to the system: idle Python workers stay, and executors count them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no GNU C library
        pass


#: Rows of an Arrow batch, where the session has Spark's own default of 10,000: rows hold whole texts, and a batch is held on both sides.
BATCH_ROWS = 2000


def bound_batches() -> None:
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_column(fn: Callable[[pa.Array], pa.Array], return_type: str, *cols: Column | str) -> Column:
    """An Arrow-batched column of ``fn``; marked non-deterministic so that the plan evaluates it once."""

    @functools.wraps(fn)
    def column(*arrays):
        try:
            return fn(*arrays)
        finally:
            release()

    bound_batches()
    udf = F.arrow_udf(column, return_type).asNondeterministic()
    return udf(*[F.col(c) if isinstance(c, str) else c for c in cols])


def texts(array: pa.Array, step: int = 512) -> Iterator[str]:
    """Python strings of an Arrow text array, null as the empty string, a few at a time."""
    for k in range(0, len(array), step):
        for x in array[k : k + step].to_pylist():
            yield x or ""


def with_fields(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """``df`` plus the named fields of one struct column. A field replaces an input column of that name."""
    keep = [c for c in df.columns if c not in names]
    tmp = "__thresher_struct"
    staged = df.withColumn(tmp, struct)
    return staged.select(*[F.col(f"`{c}`") for c in keep], *[F.col(tmp)[n].alias(n) for n in names])
