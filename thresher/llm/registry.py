"""The training-data queries of the driver entry: thin, whole-table applications of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licences, mixing, rollups, simhash, tiff, tokens, toxicity, warc
from ._common import held_out, materialise, shared_dir, table, trainable

TOKENIZER = "byte_bpe_50k.json"
TOKENIZERS = [TOKENIZER, "word_bpe_49k.json"]  # of the rollups, older first
SALTS = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(trainable("doc_id")))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_distance", "lang_rejected")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.encode(docs, tokens.TokenConfig(tokenizer_path(), width=2)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.warc_type").alias("record_type"), "refers_to")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = materialise(tiff.from_text(docs).select("doc_id", "media"), "media", "none")
    # The pages of a text are its payload in order; they are put together where they are decoded.
    pages = tiff.decoded(stored).withColumn("first", F.get("pages", F.lit(0)))
    pages = pages.withColumn("pixels", F.aggregate(F.slice("pages", 2, F.size("pages")), F.col("first.pixels"), lambda acc, p: F.concat(acc, p["pixels"])))
    pixels, ratio = F.col("pixels"), F.round(F.octet_length("media") / F.octet_length("pixels"), 4)
    form = F.concat_ws("x", "first.width", "first.compression", "first.predictor", F.size("pages"))
    return pages.select(
        "doc_id",
        F.regexp_extract("first.description", r"bytes=(\d+)", 1).cast("long").alias("n_bytes"),
        F.octet_length(pixels).cast("long").alias("payload_bytes"),
        F.sha2(pixels, 256).alias("payload_sha256"),
        F.crc32(F.substring(pixels, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", form, F.hex(F.xxhash64(pixels)), ratio).alias("feature"),
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.fit(docs))
    none = docs.select("doc_id", F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("coverage"))
    # Every id once, null among them: grouped together, not joined.
    return none.unionByName(found.select(none.columns)).groupBy("doc_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("family")), "|"), F.lit("")).alias("families"), F.count("family").alias("paragraphs"), F.max("probability").alias("probability"), F.max("coverage").alias("coverage"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, may = table(spark, sf_dir, "documents"), trainable("doc_id")
    model = toxicity.fit(docs.where(may), table(spark, sf_dir, "labels").where(may))
    return toxicity.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents counted by one tokenizer, recount those on which the newer one differs, delete exact copies,
    send the recount again. Of rows with one text that with the least doc_id (and what repeats that id) stays; rows
    without an id go where one with an id has their text."""
    docs = table(spark, sf_dir, "documents")
    old, new = versions = [n.removesuffix(".json") for n in TOKENIZERS]
    counts = rollups.counted(docs.select("doc_id", "source", "lang", "text"), dict(zip(versions, map(tokenizer_path, TOKENIZERS), strict=True)))
    slim = materialise(counts.select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), *versions), "counts")
    as_version = lambda df, v: df.select("source", "lang", F.lit(v).alias("tokenizer_version"), F.col(v).alias("n_tokens"))
    differ = F.col(old) != F.col(new)
    firsts = slim.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    # Copies of one text may be a third of all rows: each repeated digest meets them in SALTS parts.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = slim.withColumn("salt_of", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(SALTS)))
    copies = met.join(firsts, (met.digest == firsts.d) & (met.salt_of == firsts.salt)).where("doc_id > first OR doc_id IS NULL AND first IS NOT NULL")
    ledger = rollups.Ledger(spark, shared_dir(spark, "rollup"))
    recount = rollups.revise(as_version(slim.where(differ), old), as_version(slim.where(differ), new))
    ledger.commit("load", rollups.insert(as_version(slim, old)))
    ledger.commit("recount", recount)
    ledger.snapshot()
    ledger.commit("dedupe", rollups.delete(as_version(copies.where(~differ), old).unionByName(as_version(copies.where(differ), new))))
    ledger.commit("recount", recount)
    return ledger.totals()


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_shards, op3_simhash, op4_warc, op5_tiff, op6_mix, op7_licences, op8_decontamination, op9_toxicity, op10_token_rollups)}
ORACLE_SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM q""",
}
