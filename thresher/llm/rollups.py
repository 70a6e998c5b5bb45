"""Token-count rollups maintained by signed deltas, with idempotent batch commits.

A batch is a set of events (insert, delete, or revise: a delete of the old count
and an insert of the new one). Its events become additive rows a (source,
language, tokenizer version): documents and tokens with sign. They are written
aside; then a marker file under the batch's id, whose text names that folder, is
renamed into place where none may be yet. A batch that is sent again, or whose first
attempt died half way, so counts once, and of two writers one wins. Totals are
the sum of the latest snapshot and the batches after it. The marker needs a file
system whose rename without overwriting is atomic (HDFS) or one writer a ledger. The
driver holds one name a batch, never a row of counts.

Defined cases: null source, language and text are keys and a text of their own
(null text counts 0 tokens); rows whose documents and tokens sum to nothing
drop out of totals; an empty batch commits and changes nothing; repeated rows
count each; texts of any length are counted whole; other columns are not read,
and a column named like a version is replaced by its counts.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_column, with_fields
from .tokens import Encoder

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"


def insert(counts: DataFrame) -> DataFrame:
    """Events of counts(source, lang, tokenizer_version, n_tokens) that come in."""
    return counts.select(*KEYS, F.lit(1).alias("sign"), "n_tokens")


def delete(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens")


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    return delete(old).unionByName(insert(new))


def deltas(events: DataFrame) -> DataFrame:
    """Additive rows of a batch; summed per task before the shuffle, so a hot source costs nothing."""
    out = events.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0)).cast("long")).alias("tokens"))
    return out.where("docs <> 0 OR tokens <> 0")


class Ledger:
    """Batches and snapshots in one folder that all machines reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self.fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _names(self, folder: str) -> list[str]:
        p = self._p(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def _mark(self, marker: str, text: str) -> bool:
        """Put a marker file with ``text`` in place; False if there is one already."""
        goal, made = self._p(f"{self.path}/{marker}"), self._p(f"{self.path}/aside/{uuid.uuid4().hex}")
        self.fs.mkdirs(goal.getParent())
        out = self.fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(made, goal, self._no_overwrite)
            return True
        except Exception:
            self.fs.delete(made, False)
            if self.fs.exists(goal):
                return False
            raise

    def _text(self, marker: str) -> str:
        source = self.fs.open(self._p(f"{self.path}/{marker}"))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def committed(self) -> list[str]:
        return self._names("batches")

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Commit a batch; False if that id was committed before (nothing changes then)."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError("batch ids are letters, digits, - and _")
        if self.fs.exists(self._p(f"{self.path}/batches/{batch_id}")):
            return False
        aside = f"rows/{batch_id}-{uuid.uuid4().hex}"
        deltas(events).write.parquet(f"{self.path}/{aside}")
        if self._mark(f"batches/{batch_id}", aside):
            return True
        self.fs.delete(self._p(f"{self.path}/{aside}"), True)
        return False

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def _state(self) -> tuple[DataFrame, list[str]]:
        snaps, done = self._names("snapshots"), self.committed()
        if not snaps:
            return self._rows([self._text(f"batches/{b}") for b in done]), done
        folder, *inside = self._text(f"snapshots/{snaps[-1]}").split("\n")
        return self._rows([folder, *[self._text(f"batches/{b}") for b in sorted({*done} - {*inside})]]), done

    def totals(self) -> DataFrame:
        return _totals(self._state()[0])

    def snapshot(self) -> None:
        """Fold all committed batches into one snapshot, put in place when whole."""
        rows, done = self._state()
        aside = f"rows/snapshot-{uuid.uuid4().hex}"
        _totals(rows).write.parquet(f"{self.path}/{aside}")
        if not self._mark(f"snapshots/{len(self._names('snapshots')):08d}", "\n".join([aside, *done])):
            self.fs.delete(self._p(f"{self.path}/{aside}"), True)  # another writer's snapshot came first


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")


_COUNTERS: dict[str, Encoder] = {}


def counted(docs: DataFrame, versions: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` with a column of token counts a version: the ids that the tokenizer file of that version gives the whole text (null: 0)."""
    names, paths = list(versions), list(versions.values())

    def column(array: pa.Array) -> pa.Array:
        for p in paths:
            if p not in _COUNTERS:
                _COUNTERS[p] = Encoder(p, memory=48 << 20)
        return pa.StructArray.from_arrays([pa.array(_COUNTERS[p].counts(array), pa.int64()) for p in paths], names)

    kind = "struct<" + ",".join(f"`{n}`:long" for n in names) + ">"
    return with_fields(docs, arrow_column(column, kind, text_col), names)
