"""The corpus pipeline: language identification to token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm import decontaminate, langid, mixing, simhash, tokens
from thresher.llm._common import materialise, table, trainable
from thresher.llm.registry import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones, and those without a letter, go. All columns stay as they are,
    whatever their names; an empty table gives an empty one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = langid.predict(rows, langid.fit(docs.where(trainable("doc_id"))))
    return found.where(~F.col("lang_rejected")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the least id, one without an id only where none has
    any; of repeated rows one. Null and wordless texts are one group."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with no benchmark item; null and empty texts align with none. Ids and repeats don't matter."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights draw them, in mixed order; null and wordless texts are never drawn."""
    return mixing.mix(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards of what is left, read back: id, start, count and checksum; one row for each, repeated rows included."""
    return tokens.encode(docs, tokens.TokenConfig(tokenizer_path(), width=2, memory=MEMORY)).select("doc_id", "start", "n_tokens", "ids_crc32")


#: Of remembered pieces: the workers of this application have run the stages before, too.
MEMORY = 12 << 20
STAGES = [("language ID", language), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("token output", token_output)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
