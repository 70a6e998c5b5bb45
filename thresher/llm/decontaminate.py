"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

A seed is a near pair: two words of a test item, next to each other or with one
word between, that stand so in the text. An alignment that reaches ``least`` of
the item's own score has a least number of near pairs (``kept_pairs``), each at
its own place in the item. So of an item's places as many of the most common
may be left out as still leave a share ``need`` of that number; a text in which
these don't turn up can't reach ``least``, and nothing is lost. Which pairs are
common is counted within the items, so seeds depend neither on the corpus nor
on its size, and a passage that many documents share can't hide itself.

Documents meet items by a lookup of seeds; items are taken in groups of at most
``group_seeds`` words, one pass each over whole texts, so that what is
broadcast stays bounded (an item with more words is a group of its own); the driver streams items and holds one group
at a time. Around the hits, as far as an alignment can reach, the
passage is aligned with the item word by word; pairs whose score reaches
``least`` of the item's own score are returned.

Defined cases: null and wordless texts and items match nothing; an empty table on either
side gives no pair; items of one or two words are one seed; repeated rows repeat their
pairs; item ids may be of any type that casts to text and back; of equally good spans
the first is returned; texts of any length are read whole; other columns are not read by ``leaks``, and
``decontaminate`` keeps them all, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_column, texts

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class AlignConfig:
    need: float = 0.25  # share of the pairs sure to be kept that a text must show; any share finds the same
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    least: float = 0.5
    group_seeds: int = 1_000_000


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(a: np.ndarray, b: np.ndarray, c: AlignConfig) -> tuple[int, int, int]:
    """Best local score of two word-number arrays and where it ends in each (exclusive)."""
    best, ends = 0, (0, 0)
    h, ramp = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1) * -c.gap
    for i, w in enumerate(a):
        t = np.maximum(np.maximum(h + c.gap, 0), 0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(b == w, c.match, c.mismatch))
        h = np.maximum.accumulate(t + ramp) - ramp
        k = int(h.argmax())
        if h[k] > best:
            best, ends = int(h[k]), (i + 1, k)
    return best, *ends


def align_spans(a: np.ndarray, b: np.ndarray, c: AlignConfig) -> tuple[int, int, int, int, int]:
    """(score, start and end in a, start and end in b) of the best local alignment."""
    score, i, j = align(a, b, c)
    _, x, y = align(a[:i][::-1], b[:j][::-1], c)
    return score, i - x, i, j - y, j


def kept_pairs(size: int, c: AlignConfig) -> int:
    """Least number of near pairs (see the module) in any alignment of an item of ``size`` words that reaches ``least``.

    Between two consecutive matches that are no near pair lie two edits or more. An alignment of m matches has m - 1
    such steps, and its edits may cost match * (m - least * size) in all, so at most half as many steps are not near."""
    edit = min(-c.mismatch, -c.gap)
    near = lambda m: m - 1 - c.match * (m - c.least * size) / (2 * edit)
    return max(0, math.ceil(min(near(math.ceil(c.least * size)), near(size)) - 1e-9))


class Seeds:
    """The seeds of some items and their words; small enough to broadcast."""

    def __init__(self, items: list[tuple], config: AlignConfig):
        self.config = config
        vocab = sorted({w for _, ws in items for w in ws})
        self.number = {w: k + 1 for k, w in enumerate(vocab)}
        self.items = [(i, np.array([self.number[w] for w in ws], np.int64)) for i, ws in items]
        self.base = len(vocab) + 2
        often = np.bincount(np.concatenate([ids for _, ids in self.items]), minlength=self.base)
        edit = min(-config.mismatch, -config.gap)
        self.lengths = sizes = np.array([len(ids) for _, ids in self.items])
        # Words without a counterpart that an alignment may have at most.
        self.spare = np.floor(config.match * (1 - config.least) * sizes / edit).astype(np.int64)
        self.need = np.ones(len(items), np.int64)
        seeds: list[tuple[int, int, int]] = []
        for k, (_, ids) in enumerate(self.items):
            if len(ids) < 3:
                seeds.append((self._code(len(ids), ids[0], ids[-1]), k, 0))
                continue
            least = kept_pairs(len(ids), config)
            self.need[k] = max(1, math.ceil(least * config.need))
            keep = len(ids) - 1 - max(0, least - self.need[k])
            odds = often[ids[:-1]] * (often[ids[1:]] + np.append(often[ids[2:]], 0))
            for p in np.argsort(odds, kind="stable")[:keep].tolist():
                seeds += [(self._code(0, ids[p], x), k, p) for x in set(ids[p + 1 : p + 3].tolist())]
        seeds.sort()
        table = np.array(seeds, np.int64).reshape(-1, 3)
        self.codes, first = np.unique(table[:, 0], return_index=True)
        self.first = np.append(first, len(table))
        self.at_item, self.at_pos = table[:, 1].copy(), table[:, 2].copy()
        self.kinds = sorted({min(3, n) % 3 for n in sizes.tolist()})

    def _code(self, kind: int, a, b):
        """Number of a pair of words: near (0), or the whole of an item of one or two words."""
        return (kind * self.base + a) * self.base + b

    def _hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, places in the text and places in the item of all seeds in a text."""
        codes, places = [], []
        for kind in self.kinds:
            for step in {0: (1, 2), 1: (0,), 2: (1,)}[kind]:
                a, b = ids[: len(ids) - step], ids[step:]
                live = np.flatnonzero((a > 0) & (b > 0))
                codes.append(self._code(kind, a[live], b[live]))
                places.append(live)
        code, place = np.concatenate(codes), np.concatenate(places)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        found = self.codes[at] == code
        at, place = at[found], place[found]
        n = self.first[at + 1] - self.first[at]
        row = np.repeat(self.first[at] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return self.at_item[row], np.repeat(place, n), self.at_pos[row]

    def matches(self, text: str | None) -> list[tuple]:
        """(item, score, normalised score, spans) of every item that the text aligns with."""
        c = self.config
        get = self.number.get
        ws = words(text)
        ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        if not len(ids):
            return []
        item_of, place, p = self._hits(ids)
        if not len(place):
            return []
        # A hit stays if enough hits of its item start within the words that an alignment may span.
        apart = len(ids) + int(max(len(i) for _, i in self.items) + self.spare.max()) + 1
        key = item_of * apart + place
        order = np.argsort(key, kind="stable")
        item_of, place, p, key = item_of[order], place[order], p[order], key[order]
        last = np.arange(len(key)) + self.need[item_of] - 1
        inside = last < len(key)
        reach = self.lengths[item_of] + self.spare[item_of]
        near = np.flatnonzero(inside)[key[last[inside]] - key[inside] <= reach[inside]]
        hits: dict[int, list[int]] = defaultdict(list)
        for k, start in zip(item_of[near].tolist(), (place[near] - p[near]).tolist(), strict=True):
            hits[k].append(start)
        out = []
        for k, found in hits.items():
            item = self.items[k][1]
            size, slack = len(item), int(self.spare[k])
            spans, best = [], None
            for start in sorted(found):
                lo, hi = max(0, start - slack), min(len(ids), start + size + slack)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                # An upper bound first: the item's words that occur here at all.
                if c.match * int(np.isin(item, ids[lo:hi]).sum()) < c.least * c.match * size:
                    continue
                got = align(item, ids[lo:hi], c)
                if got[0] >= c.least * c.match * size and (best is None or got[0] > best[0]):
                    best = (got[0], lo, hi)
            if best:
                score, a, b, x, y = align_spans(item, ids[best[1] : best[2]], c)
                out.append((self.items[k][0], score, score / (c.match * size), best[1] + x, best[1] + y, a, b))
        return sorted(out, key=lambda r: (r[0] is None, r[0]))


_FIELDS = {"item_id": pa.string(), "score": pa.int32(), "normalised": pa.float64(), "doc_start": pa.int32(), "doc_end": pa.int32(), "item_start": pa.int32(), "item_end": pa.int32()}
_KIND = pa.list_(pa.struct(list(_FIELDS.items())))
FOUND = "array<struct<item_id:string,score:int,normalised:double,doc_start:int,doc_end:int,item_start:int,item_end:int>>"


def _matcher(held):
    names = [f.name for f in _KIND.value_type]

    def column(array: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, m, strict=True)) for m in held.value.matches(t)] for t in texts(array)], _KIND)

    return column


def _groups(benchmark: DataFrame, item_col: str, item_text: str, config: AlignConfig) -> Iterator[Seeds]:
    """Seeds of the items with words, in the order of their ids, a bounded group at a time."""
    group, size = [], 0
    ordered = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).orderBy(F.col(item_col).asc_nulls_last(), "t")
    for r in ordered.toLocalIterator():
        ws = words(r["t"])
        if not ws:
            continue
        if group and size + len(ws) > config.group_seeds:
            yield Seeds(group, config)
            group, size = [], 0
        group.append((r["i"], ws))
        size += len(ws)
    if group:
        yield Seeds(group, config)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", config: AlignConfig = AlignConfig()) -> DataFrame:
    """One row a (document, item) pair that aligns: id, item_id, score, normalised, word spans (ends exclusive)."""
    spark, item_type = docs.sparkSession, benchmark.schema[item_col].dataType
    parts = []
    for seeds in _groups(benchmark, item_col, item_text, config):
        held = spark.sparkContext.broadcast(seeds)
        parts.append(docs.select(F.col(id_col).alias("__id"), F.explode(arrow_column(_matcher(held), FOUND, text_col)).alias("m")))
    if not parts:
        parts.append(docs.where("false").select(F.col(id_col).alias("__id"), F.explode(F.array().cast(FOUND)).alias("m")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    rest = [F.col("m")[n].alias(n) for n in _FIELDS if n != "item_id"]
    return out.select(F.col("__id").alias(id_col), F.col("m.item_id").cast(item_type).alias("item_id"), *rest)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", config: AlignConfig = AlignConfig()) -> DataFrame:
    """``docs`` without the documents that align with a test item; each row is judged by its own text, and nothing is shuffled."""
    kept = docs
    for seeds in _groups(benchmark, item_col, item_text, config):
        held = docs.sparkSession.sparkContext.broadcast(seeds)
        kept = kept.withColumn("__leaks", F.size(arrow_column(_matcher(held), FOUND, text_col))).where("__leaks = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept
