"""SimHash near-duplicates through vantage-point trees, exact at the stated radius.

Fingerprints are made distinct first, so copies never multiply work. Two 64-bit
fingerprints within 3 bits agree within 1 bit on at least one 32-bit half; for
each half a vantage-point tree (from a bounded sample of fingerprints) deals all
fingerprints to shards by Hamming distance. Each fingerprint lives in one shard
of a tree and, as a query, visits just the shards that the triangle bounds
cannot rule out. A shard holds its part in a local vantage-point tree over all
64 bits, skips subtrees that already belong to the query's component, and
returns a star of links per local component instead of pairs. Links are then
contracted to components by alternating large-star and small-star steps, with
a durable write after each. The sample grows with the shards; a shard that a
ball of close fingerprints overfills is cut into blocks that every asking
fingerprint visits. Each level of a dealing tree sends those near its border both ways, so
what is dealt grows faster than the fingerprints (about as n to the power 1.36).

Defined cases: null or wordless text has fingerprint zero and links like any
other; a null document id takes part in linking but is never a component's
name unless all its members are null; repeated rows give repeated rows (and
``deduplicate`` keeps one of them); texts of any length are read whole; an empty table gives
an empty one; ties go to the least id, then the least hash of the row; an
input column named like an output column is not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, arrow_column, join_hot, materialise, texts


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 3
    seed: int = 42
    radius: int = 3
    sample: int = 20_000  # fingerprints, at least, that shape the two dealing trees
    sample_rows: int = 4  # for each shard
    shard_rows: int = 100_000  # fingerprints that a shard should hold; four times as many cut it into blocks
    leaf: int = 256


def fingerprint(text: str, config: SimHashConfig = SimHashConfig()) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k, joined = config.shingle, b" ".join(words)
    if len(words) <= k:
        hashes = np.array([xxhash.xxh64_intdigest(joined, config.seed)], np.uint64)
    else:
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n + 1) - 1
        starts, stops, digest, seed, view = (ends - n)[: 1 - k].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest, config.seed, joined
        hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[a : a + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", config: SimHashConfig = SimHashConfig(), out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long column."""

    def column(array: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, config) for t in texts(array)], np.uint64).view(np.int64), pa.int64())

    return docs.withColumn(out, arrow_column(column, "long", text_col))


# ------------------------------------------------------------ dealing trees


class DealTree:
    """A vantage-point tree over one half of the bits; its leaves are shards."""

    def __init__(self, sample: np.ndarray, shift: int, shards: int, radius: int):
        self.shift, self.radius, self.nodes, self.leaves = np.uint64(shift), radius, [], 0
        half = np.unique((sample >> self.shift) & np.uint64(0xFFFFFFFF))
        self._grow(half, max(1, -(-len(half) // max(1, shards))))

    def _grow(self, x: np.ndarray, most: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(x) > max(1, most):
            # The candidate whose median split leaves the fewest near the border.
            best = None
            for v in x[:: max(1, len(x) // 7)][:8]:
                d = np.bitwise_count(x ^ v)
                for r in {int(np.quantile(d, q)) for q in (0.4, 0.5, 0.6)}:
                    inside = int((d <= r).sum())
                    if 0 < inside < len(x):
                        cost = int(((d > r - self.radius) & (d <= r + self.radius)).sum()) + abs(2 * inside - len(x)) // 2
                        if best is None or cost < best[0]:
                            best = cost, v, r, d
            if best is not None and int(((best[3] > best[2] - self.radius) & (best[3] <= best[2] + self.radius)).sum()) < 0.7 * len(x):
                _, v, r, d = best
                self.nodes[me] = (v, r, self._grow(x[d <= r], most), self._grow(x[d > r], most))
                return me
        self.nodes[me] = self.leaves
        self.leaves += 1
        return me

    def deal(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, lives here) of every shard that each fingerprint lives in or must ask."""
        half = (fps >> self.shift) & np.uint64(0xFFFFFFFF)
        rows, shards, homes = [], [], []
        stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if isinstance(self.nodes[node], int):
                rows.append(at), shards.append(np.full(len(at), self.nodes[node])), homes.append(home)
                continue
            v, r, inner, outer = self.nodes[node]
            d = np.bitwise_count(half[at] ^ v).astype(np.int64)
            a, b = d <= r + self.radius, d > r - self.radius
            stack.append((inner, at[a], home[a] & (d[a] <= r)))
            stack.append((outer, at[b], home[b] & (d[b] > r)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return cat(rows, np.int64), cat(shards, np.int64), cat(homes, bool)


# ------------------------------------------------------------ inside a shard


class _Components:
    """Union-find over positions, in numpy: labels are the least position reached."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            lo, hi = np.minimum(la, lb), np.maximum(la, lb)
            off = lo != hi
            if not off.any():
                return
            np.minimum.at(self.label, hi[off], lo[off])
            while (self.label != (up := self.label[self.label])).any():
                self.label = up


def local_links(fps: np.ndarray, home: np.ndarray, radius: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, the least fingerprint of its local component) that follow from
    all pairs within the radius of which at least one lives here."""
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    comp = _Components(len(fps))
    mine = np.flatnonzero(home)

    def visit(points: np.ndarray, asking: np.ndarray) -> None:
        stack = [(points, asking)]
        while stack:
            pts, q = stack.pop()
            if not len(pts) or not len(q):
                continue
            lp = comp.label[pts]
            if (lp == lp[0]).all():  # a pure subtree has nothing new for its own component
                q = q[comp.label[q] != lp[0]]
                if not len(q):
                    continue
            if len(pts) <= leaf:
                for a in range(0, len(q), 4096):
                    part = q[a : a + 4096]
                    i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[pts][None, :]) <= radius)
                    comp.join(part[i], pts[j])
                continue
            v = pts[len(pts) // 2]
            d = np.bitwise_count(fps[pts] ^ fps[v]).astype(np.int64)
            near = pts[d <= radius]
            comp.join(near, np.full(len(near), v))  # a dense ball collapses at once
            r = int(np.median(d))
            if (d <= r).all():
                r -= 1
            inner, outer = pts[d <= r], pts[d > r]
            if not len(inner) or not len(outer):
                v_rest = pts[pts != v]
                dq = np.bitwise_count(fps[q] ^ fps[v])
                hit = q[dq <= radius]
                comp.join(hit, np.full(len(hit), v))
                stack.append((v_rest, q))
                continue
            dq = np.bitwise_count(fps[q] ^ fps[v]).astype(np.int64)
            stack.append((outer, q[dq > r - radius]))
            stack.append((inner, q[dq <= r + radius]))

    visit(mine, np.arange(len(fps)))
    root = comp.label
    off = root != np.arange(len(fps))
    return fps[off], fps[root[off]]


def links(fps: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(a, b): links between different fingerprints whose transitive closure is that of all
    pairs within the radius. ``fps`` has one distinct non-null long column ``fp``."""
    spark = fps.sparkSession
    n = fps.count()
    shards = max(1, -(-n // config.shard_rows), min(n // 500, 2 * spark.sparkContext.defaultParallelism))
    size = max(config.sample, config.sample_rows * shards)
    keep = min(1.0, size / max(1, n))
    picked = [r["fp"] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(keep * (1 << 30)) + 1).limit(4 * size).collect()]
    sample = np.sort(np.array(picked, np.int64).view(np.uint64)) if picked else np.zeros(0, np.uint64)
    held = spark.sparkContext.broadcast([DealTree(sample, shift, shards, config.radius // 2) for shift in (0, 32)])

    def deal(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(held.value):
                rows, shard, home = tree.deal(x)
                yield pa.RecordBatch.from_arrays([pa.array(shard * 2 + k), pa.array(x[rows].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def within(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        fp, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy(zero_copy_only=False)
        a, b = local_links(fp, home, config.radius, config.leaf)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    dealt = materialise(fps.mapInArrow(deal, "shard long, fp long, home boolean"), "dealt")
    # In a shard that is too full every block holds a part and is asked by all, so that no pair is lost.
    full = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 4 * config.shard_rows).collect()
    blocks = F.lit(1)
    for r in full:
        blocks = F.when(F.col("shard") == r["shard"], F.lit(-(-r["n"] // (2 * config.shard_rows)))).otherwise(blocks)
    cut = dealt.withColumn("m", blocks.cast("long"))
    cut = cut.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    cut = cut.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("m")) == F.col("block")))
    return cut.select("shard", "block", "fp", "home").groupBy("shard", "block").applyInArrow(within, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``edges(a, b)``, by alternating
    large-star and small-star steps; each step's links are written before the next reads them."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        n = now.count()
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(both, least, "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialise(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s"), F.countDistinct("a").alias("d")).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)


def _classes(docs: DataFrame, id_col: str, text_col: str, config: SimHashConfig) -> tuple[DataFrame, DataFrame]:
    """(id, h, fp) of every row, and (fp, n, component_id, rep) of every fingerprint, n counting its rows; rep is the
    (null id, id, h) of the row that stands for the component. h hashes the whole row."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    base = materialise(fingerprints(docs.select(F.col(id_col).alias("id"), content.alias("h"), F.col(text_col).alias("t")), "t", config).select("id", "h", "fp"), "fps")
    groups = materialise(base.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep"), F.count("*").alias("n")), "fpgroups")
    roots = materialise(components(docs.sparkSession, links(groups.select("fp"), config)), "roots")
    # Fingerprints without a link are components of their own; only the others are grouped by root.
    alone = groups.join(roots.select(F.col("node").alias("fp")).union(roots.select(F.col("root").alias("fp"))).distinct(), "fp", "left_anti")
    linked = groups.join(roots, groups.fp == roots.node, "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    linked = linked.join(roots.select("root").distinct(), "root", "left_semi")
    by_root = linked.groupBy("root").agg(F.min("rep").alias("best"), F.count("*").alias("m"))
    met = join_hot(linked, materialise(by_root, "reps"), "root", "m", groups.count())
    named = met.select("fp", "n", F.col("best").alias("rep")).unionByName(alone.select("fp", "n", "rep"))
    return base, materialise(named.select("fp", "n", F.col("rep.id").alias("component_id"), "rep"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (least id reachable) of every row."""
    base, classes = _classes(docs, id_col, text_col, config)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    named = join_hot(base, classes.select("fp", "n", "component_id"), "fp", "n", base.count())
    return named.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """One row of each component: its least id (a null one only where no row has any) and, of rows that repeat
    that id, one with the least row hash. Texts stay where they are unless more rows go than may be broadcast."""
    base, classes = _classes(docs, id_col, text_col, config)
    named = join_hot(base, classes.select("fp", "n", F.col("rep.id").alias("i"), F.col("rep.h").alias("k")), "fp", "n", base.count())
    stays = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))
    gone = materialise(named.where(~stays).select("id", "h").distinct(), "gone")
    twice = named.where(stays).groupBy("id", "h").count().where("count > 1").select("id", "h")
    twice = materialise(twice, "twice")
    rows = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    sized = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = rows.join(sized(gone.select(F.col("id").alias("__i"), F.col("h").alias("__h"))), F.col(f"`{id_col}`").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__h")), "left_anti")
    if twice.isEmpty():
        return kept.select(*columns)
    pairs = twice.select(F.col("id").alias("__i"), F.col("h").alias("__h"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__h"))
    once = kept.join(sized(pairs), same, "left_anti").select(*columns)
    # Rows alike in all columns: each task keeps one before any is moved.
    many = kept.join(sized(pairs), same, "left_semi").select("__row", F.struct(*columns).alias("__all"))
    return once.unionByName(many.groupBy("__row").agg(F.any_value("__all").alias("__all")).select("__all.*"))
