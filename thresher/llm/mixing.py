"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents fall into permuted blocks of their source by hash. A source's target
words become whole passes over all its blocks plus a part pass: leading blocks
of that pass's permutation, and of the last of them its leading documents. The exact
counts of blocks that each source owes are split between the halves of the
output shards, recursively, by multivariate-hypergeometric draws (of groups of
sources first, where there are many, then within each group); each shard
then owns the next disjoint blocks of each source's permutation and shuffles
what it holds by hash.

A permutation is the order of the blocks' hashes, so that what a source draws, and
which shard owns it, is a few limits in that order: one row a source. Rows are
placed by comparing hashes with them. Rows of equal id, text and source count as
one document in several copies, and a limit may fall between copies.

All choices are functions of the seed and the data, so that reruns agree. The
driver sees sums and at most ``groups`` rows.

Defined cases: null text has size 0 and is never taken; null sources are a
source of their own, last; copies of a row are taken alike but for those of the one
document where a source's target falls, of which so many are taken as come nearest; of rows
that repeat id, text and source but differ elsewhere, one stands for all in ``mix``; a source without
words has target 0; texts of any length are counted whole; an empty table gives an empty mix. Input columns named like
an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # over the sources in order, repeating
    share: float = 1.5  # of all words
    most: float = 2.0  # times a source's words
    shards: int = 16  # at least; more by ``shard_words``, up to ``most_shards``
    most_shards: int = 256
    shard_words: int = 50_000_000
    part_words: int = 10_000_000  # of a shard in one output partition
    block_rows: int = 64
    blocks: int = 1 << 16  # a source, at most
    groups: int = 4096
    broadcast_rows: int = 100_000  # a table of more rows is joined by shuffle, hot sources apart
    seed: int = 7


def targets(sizes: list[int], config: MixConfig = MixConfig()) -> list[float]:
    """Target words of sources in order: shares by weight, none above ``most`` times its size."""
    w = [config.weights[k % len(config.weights)] for k in range(len(sizes))]
    cap = [config.most * s for s in sizes]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), config.share * sum(sizes)
    while free:
        total = sum(w[k] for k in free)
        over = {k for k in free if left * w[k] / total > cap[k]}
        if not over:
            for k in free:
                out[k] = left * w[k] / total
            break
        for k in over:
            out[k] = cap[k]
        left -= sum(cap[k] for k in over)
        free -= over
    return out


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): a tree whose every node draws its
    left half's blocks from its own, without replacement."""
    out = np.zeros((shards, len(quota)), np.int64)
    stack = [(0, shards, quota.astype(np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(round(int(q.sum()) * (mid - lo) / (hi - lo)))
        left = rng.multivariate_hypergeometric(q, n, method="marginals") if q.sum() else q * 0
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _key(config: MixConfig, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(config.seed), F.col(id_col), F.col(text_col))


def _attach(rows: DataFrame, sources: DataFrame, n: int, config: MixConfig) -> DataFrame:
    """Every row with the columns of its source (``__src``, null-safe)."""
    table = sources.withColumnRenamed("__src", "__name")
    drop = lambda df: df.drop("__name", "n")
    on = F.col("__src").eqNullSafe(F.col("__name"))
    if n <= config.broadcast_rows:
        return drop(rows.join(F.broadcast(table), on))
    # At most 4096 sources have that many rows; the others are no hot keys.
    edge = sources.agg(F.sum("n") / 4096).first()[0]
    hot = F.broadcast(table.where(F.col("n") > edge))
    return drop(rows.join(hot, on)).unionByName(drop(rows.join(table.where(F.col("n") <= edge), on)))


def _ranked(df: DataFrame, order: Column) -> DataFrame:
    """``df``, written once, with ``k``: each row's place from 0 in the order."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = materialise(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumns({"__p": F.spark_partition_id(), "__i": place}), "mixranks")
    counts = sorted((r["__p"], r["n"]) for r in laid.groupBy("__p").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    begin = spark.createDataFrame(starts, "__p int, __at long")
    return laid.join(F.broadcast(begin), "__p").withColumn("k", F.col("__at") + F.col("__i")).drop("__p", "__i", "__at")


def _level(sources: DataFrame, goal: float, config: MixConfig) -> float:
    """Target words a unit of weight of the sources that stay below their most."""
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < level * F.col("w")
        r = sources.agg(F.sum(over.cast("long")).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if not r["w"] or r["n"] == capped:
            return level if r["w"] else float("inf")
        capped, level = r["n"], (goal - (r["cap"] or 0.0)) / r["w"]


def _owed(quotas: DataFrame, n: int, shards: int, config: MixConfig) -> DataFrame:
    """(k, shard, upto): of each source's drawn blocks in order, how many the shards up to this one own."""
    spark, groups = quotas.sparkSession, min(max(1, n), config.groups)
    grouped = quotas.withColumn("g", F.floor(F.col("k") * groups / max(1, n)).cast("int"))
    total = {r["g"]: r["q"] for r in grouped.groupBy("g").agg(F.sum("q").alias("q")).collect()}
    quota = np.array([total.get(g, 0) for g in range(groups)], np.int64)
    owed = split(quota, shards, np.random.Generator(np.random.PCG64(config.seed)))
    if n <= groups:
        upto = np.cumsum(owed, 0)
        rows = [(int(k), int(s), int(upto[s, k])) for s, k in zip(*np.nonzero(owed), strict=True)]
        return spark.createDataFrame(rows, "k long, shard int, upto long")
    held, seed = spark.sparkContext.broadcast(owed), config.seed

    def within(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        g, left = int(pdf["g"].iloc[0]), pdf["q"].to_numpy(np.int64)
        rng, have, out = np.random.Generator(np.random.PCG64([seed, g])), np.zeros(len(pdf), np.int64), []
        for s, count in enumerate(held.value[:, g].tolist()):
            got = rng.multivariate_hypergeometric(left, count, method="marginals") if count else left * 0
            left, have = left - got, have + got
            at = np.flatnonzero(got)
            out.append(pd.DataFrame({"k": pdf["k"].to_numpy()[at], "shard": np.full(len(at), s, np.int32), "upto": have[at]}))
        return pd.concat(out)

    return grouped.groupBy("g").applyInPandas(within, "k long, shard int, upto long")


def _block(config: MixConfig) -> Column:
    return F.pmod(F.xxhash64(F.lit(config.seed + 1), F.col("__h")), F.col("blocks"))


def _turn(config: MixConfig, turn: Column) -> Column:
    """A block's place in the permutation of a pass."""
    return F.xxhash64(F.lit(config.seed + 3), F.col("k"), turn, F.col("b"))


def _tables(docs: DataFrame, id_col: str, text_col: str, source_col: str, config: MixConfig) -> tuple[DataFrame, DataFrame, int, int]:
    """Documents (id, __src, __h, size, copies), sources (one row each, with all limits of what is drawn), the number of sources and of words drawn."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    each = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("__src"), _key(config, id_col, text_col).alias("__h"), words.alias("size"))
    slim = materialise(each.groupBy("__src", "__h").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.count("*").alias("copies")), "mixsizes")
    plain = slim.groupBy("__src").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    ranked = _ranked(plain, F.col("__src").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in config.weights])[(F.col("k") % len(config.weights)).cast("int")]
    sources = ranked.withColumns({"w": weight, "cap": config.most * F.col("source_size")})
    facts = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("s")).first()
    n, level = facts["n"], _level(sources, config.share * (facts["s"] or 0), config)
    log = F.least(F.lit(config.blocks.bit_length() - 1), F.ceil(F.log2(F.greatest(F.col("n") / config.block_rows, F.lit(1.0)))).cast("int"))
    sources = sources.withColumns({"target": F.least(F.col("cap"), level * F.col("w")), "blocks": F.pow(F.lit(2), log).cast("long")})
    goal = F.round("target").cast("long")
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("int"))
    sources = sources.withColumn("rest", F.when(F.col("source_size") > 0, goal - F.col("whole") * F.col("source_size")).otherwise(0))
    sources = materialise(sources.select("k", "__src", "n", "source_size", "target", "blocks", "whole", "rest"), "mixsources")
    drawn = sources.agg(F.sum(F.col("whole") * F.col("source_size") + F.col("rest"))).first()[0] or 0
    shards = max(config.shards, min(config.most_shards, -(-drawn // config.shard_words)))

    # Blocks, and the units (pass, block) that are drawn of them; a source has at most ``blocks``.
    placed = _attach(slim, sources.select("k", "__src", "n", "blocks"), n, config).withColumn("b", _block(config))
    blocks = placed.groupBy("k", "b").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).join(sources.where("source_size > 0").select("k", "whole", "rest"), "k")
    units = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    units = units.withColumn("at", _turn(config, F.col("pass")))
    turn = Window.partitionBy("k", "pass").orderBy("at", "b")
    units = units.withColumn("before", F.sum("words").over(turn) - F.col("words")).where("pass < whole OR before < rest")
    units = materialise(units.withColumn("u", F.row_number().over(Window.partitionBy("k").orderBy("pass", "at", "b")).cast("long")), "mixunits")
    runs = _owed(units.groupBy("k").agg(F.count("*").alias("q")), n, shards, config)
    ends = units.join(runs, (units.k == runs.k) & (units.u == runs.upto)).select(units.k, F.struct("pass", "at", "b", "shard").alias("end"))
    ends = ends.groupBy("k").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    # Where the part pass stops: a block, and in it a document and how many copies of it.
    cuts = units.where("pass = whole AND before + words >= rest").select("k", F.col("at").alias("cut_at"), F.col("b").alias("cut_b"), (F.col("rest") - F.col("before")).alias("fit"))
    inside = placed.join(cuts, (placed.k == cuts.k) & (placed.b == cuts.cut_b)).select(placed.k, "__h", "size", "copies", "fit")
    run = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("k").orderBy("__h"))
    inside = inside.withColumn("before", run - F.col("size") * F.col("copies")).where("before <= fit AND before + size * copies > fit")
    stop = inside.groupBy("k").agg(F.min("__h").alias("cut_h"), F.min_by(F.floor((F.col("fit") - F.col("before")) / F.col("size") + 0.5), "__h").alias("cut_copies"))
    full = sources.join(cuts.drop("fit"), "k", "left").join(stop, "k", "left").join(ends, "k", "left")
    return slim, materialise(full, "mixlimits"), n, drawn


def _draws(config: MixConfig, copies: Column, some: Column) -> Column:
    """What is drawn of a row that has its source's columns and ``b``: pass, shard and number of copies."""
    none = F.array().cast("array<struct<pass:int,shard:int,copies:long>>")

    def draw(turn: Column) -> Column:
        at = _turn(config, turn)
        end = F.get(F.filter("ends", lambda e: F.struct(e["pass"].alias("x"), e["at"].alias("y"), e["b"].alias("z")) >= F.struct(turn.alias("x"), at.alias("y"), F.col("b").alias("z"))), F.lit(0))
        place, cut = F.struct(at.alias("y"), F.col("b").alias("z")), F.struct(F.col("cut_at").alias("y"), F.col("cut_b").alias("z"))
        edge = F.when(F.col("cut_h").isNull() | (F.col("__h") < F.col("cut_h")), copies).when(F.col("__h") == F.col("cut_h"), F.least(copies, "cut_copies")).otherwise(0)
        part = F.when(F.col("cut_at").isNull(), 0).when(place < cut, copies).when(place == cut, edge).otherwise(0)
        return F.struct(turn.cast("int").alias("pass"), end["shard"].cast("int").alias("shard"), F.when(turn < F.col("whole"), copies).otherwise(part).cast("long").alias("copies"))

    return F.when(some & (F.col("source_size") > 0), F.filter(F.transform(F.sequence(F.lit(0), F.col("whole")), draw), lambda d: d["copies"] > 0)).otherwise(none)


def _each_copy(df: DataFrame, copies: str, most: int) -> DataFrame:
    """``df`` with one row for each of ``copies``, numbered in ``__j``. Where one row makes many they are dealt out first."""
    step = 1000
    if most > step:
        df = df.withColumn("__a", F.explode(F.sequence(F.lit(0), F.col(copies) - 1, F.lit(step))))
        return df.repartition().withColumn("__j", F.explode(F.sequence("__a", F.least(F.col("__a") + step, F.col(copies)) - 1))).drop("__a")
    return df.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", config: MixConfig = MixConfig()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, draws.

    ``draws`` lists, for each time that the document is taken, the pass, the
    shard and the place key within the shard.
    """
    slim, limits, n, _ = _tables(docs, id_col, text_col, source_col, config)
    most = slim.agg(F.max("copies")).first()[0] or 1
    rows = _attach(slim, limits, n, config).withColumn("b", _block(config)).withColumn("__d", _draws(config, F.col("copies"), F.col("size") > 0))
    rows = _each_copy(rows, "copies", most)
    mine = F.filter("__d", lambda d: d["copies"] > F.col("__j"))
    draws = F.transform(mine, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(config.seed + 2), d["pass"], F.col("__h"), F.col("__j")).alias("place")))
    return rows.select(F.col("id").alias(id_col), F.col("__src").alias(source_col), "size", "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", config: MixConfig = MixConfig()) -> DataFrame:
    """The mixed rows themselves: ``docs``' columns plus mix_shard and mix_place, each document
    as often as it is drawn, dealt by shard and in shuffled order within it. Texts move once."""
    slim, limits, n, drawn = _tables(docs, id_col, text_col, source_col, config)
    keep = [c for c in docs.columns if c not in ("mix_shard", "mix_place")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(source_col).cast("string").alias("__src"), _key(config, id_col, text_col).alias("__h"), F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("__some"))
    repeated = slim.where("copies > 1").select(F.col("__src").alias("__s"), F.col("__h").alias("__k"), "copies")
    facts = repeated.agg(F.count("*").alias("n"), F.max("copies").alias("most")).first()
    rows = packed.withColumn("copies", F.lit(1).cast("long"))
    if facts["n"]:
        # One row stands for all its copies: each task keeps one of them before any is moved.
        table = F.broadcast(repeated) if facts["n"] <= config.broadcast_rows else repeated
        met = packed.join(table, F.col("__src").eqNullSafe(F.col("__s")) & (F.col("__h") == F.col("__k")), "left").drop("__s", "__k")
        ones = met.where("copies IS NULL").withColumn("copies", F.lit(1).cast("long"))
        many = met.where("copies IS NOT NULL").groupBy("__src", "__h", "copies").agg(F.any_value("__row").alias("__row"), F.any_value("__some").alias("__some"))
        rows = ones.unionByName(many.select(ones.columns))
    rows = _attach(rows, limits, n, config).withColumn("b", _block(config))
    rows = rows.select("__row", "__h", F.explode(_draws(config, F.col("copies"), F.col("__some"))).alias("__d"))
    rows = _each_copy(rows.withColumn("__n", F.col("__d.copies")), "__n", facts["most"] or 1)
    place = F.xxhash64(F.lit(config.seed + 2), F.col("__d.pass"), F.col("__h"), F.col("__j"))
    out = rows.select("__row.*", F.col("__d.shard").alias("mix_shard"), place.alias("mix_place"))
    shards = max(config.shards, min(config.most_shards, -(-drawn // config.shard_words)))
    parts = max(1, -(-drawn // (shards * config.part_words)))
    return out.repartitionById(shards * parts, (F.col("mix_shard") * parts + F.pmod("mix_place", F.lit(parts))).cast("int")).sortWithinPartitions("mix_shard", "mix_place")
