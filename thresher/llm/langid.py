"""Language identification by nearest TF-IDF n-gram centroid.

Every text becomes a hashed bag of byte n-grams (letters only, lower case),
weighted by smoothed IDF and normalised. Each language has several centroids
from spherical k-means; a text takes the language of the centroid with the
smallest cosine distance; a cluster that holds few of its language's texts (a
foreign passage, junk) makes no centroid. A text whose distance is too large for its length
is rejected: the limit lies between the distances of training texts to their own
language and, each language left out in turn, to the others.

Defined cases: null text or text without a letter (numerals such as ½ or Ⅷ are
none) gives ``und``, score 0, rejected. No usable training rows, or an empty
table to learn from, gives ``und`` for all; an empty table to predict gives an empty
one. Texts of any length are scored whole. Repeated rows are scored alike (and drawn
once for the fit); ties between centroids go to the first language by code point.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_column, texts, with_fields

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numerals that count as word characters but are neither letters nor decimal digits. Only the class of the
#: first plane is quick to test, so texts beyond it are tested again.
_CLASS = lambda a, b: re.compile("[" + "".join(c for c in map(chr, range(a, b)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "]+")
_NUMERALS, _FAR_NUMERALS = _CLASS(0x80, 0x10000), _CLASS(0x10000, 0x20000)
OUT = ["lang_pred", "score", "lang_distance", "lang_rejected"]
OUT_TYPE = "struct<lang_pred:string,score:double,lang_distance:double,lang_rejected:boolean>"


@dataclass(frozen=True)
class LangIdConfig:
    """Fit bounds: at most about ``rows_per_language`` texts of a language, and ``sample_rows`` of all, shape the
    centroids; IDF counts come from every training row."""

    dims_log2: int = 14
    sizes: tuple[int, ...] = (2, 3)
    centroids: int = 4
    rounds: int = 8
    rows_per_language: int = 800
    sample_rows: int = 40_000
    least_share: float = 0.05  # of a language's sampled texts that a centroid needs
    own_tail: float = 0.01  # of training texts are farther from their own language than the limits are set by
    foreign_tail: float = 0.05  # of texts of a language left out are nearer to the others than that
    slack: float = 0.3  # of the own tail where there is no other language to leave out


@dataclass
class LangIdModel:
    config: LangIdConfig
    languages: list[str]
    owner: np.ndarray  # language number of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # dims x centroids
    floor: list[float] = field(default_factory=list)  # least cosine kept, by length class


def codes(text: str, config: LangIdConfig) -> np.ndarray:
    """Hashed n-gram numbers of a text, repeats included."""
    clean = _NOT_LETTERS.sub(" ", text.lower())
    if not clean.isascii():
        if _NUMERALS.search(clean):
            clean = _NUMERALS.sub(" ", clean)
        if 2 * len(clean) != len(clean.encode("utf-16-le", "replace")):
            clean = _FAR_NUMERALS.sub(" ", clean)
    clean = clean.strip()
    if not clean:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(f" {clean} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    shift = np.uint32(32 - config.dims_log2)
    parts = []
    for n in config.sizes:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(257) + b[k : len(b) - n + 1 + k]
        parts.append((h * np.uint32(2654435761)) >> shift)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def vector(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(np.bincount(c, minlength=len(idf)).astype(np.float32)) * idf
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def length_class(n: int) -> int:
    return max(0, n).bit_length()


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", config: LangIdConfig = LangIdConfig()) -> LangIdModel:
    """Learn from every row given (callers filter); rows with null text or label are left out."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    dims = 1 << config.dims_log2
    if not languages:
        return LangIdModel(config, [], np.zeros(0, np.int64), np.ones(dims, np.float32), np.zeros((dims, 0), np.float32))
    df_counts, total = _document_frequencies(rows, config)
    idf = (np.log((1 + total) / (1 + df_counts)) + 0.1).astype(np.float32)
    # A row is drawn when its hash falls below the share that its language needs.
    most = min(config.rows_per_language, max(1, config.sample_rows // len(languages)))
    share = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(min(1.0, most / counts[l])))])
    draw = F.pmod(F.xxhash64(F.col("i"), F.col("t")), F.lit(1 << 30)) < share[F.col("l")] * (1 << 30)
    sample = sorted(((r["l"], r["t"]) for r in rows.where(draw).select("l", "t").distinct().collect()), key=lambda x: (x[0], x[1]))
    owner, cents, points = [], [], []
    for k, lang in enumerate(languages):
        grams = [g for g in (codes(t, config) for l, t in sample if l == lang) if len(g)]
        if not grams:
            continue
        x = np.stack([vector(g, idf) for g in grams])
        found = _spherical_kmeans(x, config)
        owner += [k] * len(found)
        cents.append(found)
        points += [(k, length_class(len(g)), at := np.flatnonzero(v), v[at]) for g, v in zip(grams, x, strict=True)]
        del x, grams
    if not cents:
        return LangIdModel(config, [], np.zeros(0, np.int64), idf, np.zeros((dims, 0), np.float32))
    every, of = np.concatenate(cents).T.copy(), np.array(owner)
    own, foreign, several = [], [], len(set(owner)) > 1
    for k, length, at, v in points:
        cos = v @ every[at]
        own.append((length, float(cos[of == k].max())))
        if several:
            foreign.append((length, float(cos[of != k].max())))
    return LangIdModel(config, languages, of, idf, every, _floors(own, config, foreign))


def _document_frequencies(rows: DataFrame, config: LangIdConfig) -> tuple[np.ndarray, int]:
    """Document frequency of every hashed n-gram over all rows, summed per task before the shuffle."""
    dims = 1 << config.dims_log2

    def partial(batches):
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for t in texts(b.column(0)):
                df[np.unique(codes(t, config)) if len(t) < 512 else np.flatnonzero(np.bincount(codes(t, config), minlength=dims))] += 1
                n += 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1), pa.int64()), pa.array(np.append(df[k], n), pa.int64())], ["k", "n"])

    summed = rows.select("t").mapInArrow(partial, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(dims), 0
    for r in summed:
        if r["k"] < 0:
            total = r["n"]
        else:
            out[r["k"]] = r["n"]
    return out, total


def _spherical_kmeans(x: np.ndarray, config: LangIdConfig) -> np.ndarray:
    """Centroids by farthest-first start. Rows of clusters too small for a centroid are put aside
    and the rest is clustered again, until none is too small."""
    for _ in range(config.rounds):
        cents = _clusters(x, config)
        near = np.argmax(x @ cents.T, 1)
        held = np.bincount(near, minlength=len(cents))
        enough = (held >= config.least_share * len(x)) | (held == held.max())
        if enough.all():
            break
        x = x[enough[near]]
    return cents[enough]


def _clusters(x: np.ndarray, config: LangIdConfig) -> np.ndarray:
    mean = x.mean(0)
    picks = [int(np.argmax(x @ mean))]
    while len(picks) < min(config.centroids, len(x)):
        picks.append(int(np.argmin((x @ x[picks].T).max(1))))
    cents = x[sorted(set(picks))]
    for _ in range(config.rounds):
        near = np.argmax(x @ cents.T, 1)
        sums = [x[near == k].sum(0) for k in range(len(cents)) if (near == k).any()]
        cents = np.stack([s / max(1e-9, np.linalg.norm(s)) for s in sums])
    return cents.astype(np.float32)


def _floors(own: list[tuple[int, float]], config: LangIdConfig, foreign: list[tuple[int, float]] = ()) -> list[float]:
    """Least accepted cosine by length class: the geometric mean of the low tail of the training texts
    of that class and the high tail of those compared with other languages only, but never above nine tenths of the first; without
    such, a share of the first. A class with few texts takes the floor of the nearest class that has enough, the shorter of two."""
    by_class: dict[int, list[float]] = {}
    away: dict[int, list[float]] = {}
    for seen, into in ((own, by_class), (foreign, away)):
        for k, c in seen:
            into.setdefault(k, []).append(c)
    known = {}
    for k, v in by_class.items():
        if len(v) >= 20:
            low = float(np.quantile(v, config.own_tail))
            high = float(np.quantile(away[k], 1 - config.foreign_tail)) if k in away else config.slack**2 * low
            known[k] = min(0.9 * low, float(np.sqrt(max(0.0, low * high))))
    if not known:
        return [config.slack * min(c for _, c in own)] * (max(by_class) + 1)
    return [known[min(known, key=lambda j: (abs(j - k), j))] for k in range(max(by_class) + 1)]


def predict(docs: DataFrame, model: LangIdModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (best cosine, 0 to 1), lang_distance, lang_rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def classify(array: pa.Array) -> pa.Array:
        m = held.value
        pred, score, dist, rejected = [], [], [], []
        for t in texts(array):
            c = codes(t, m.config)
            if not len(c) or not m.languages:
                pred.append("und"), score.append(0.0), dist.append(1.0), rejected.append(True)
                continue
            cos = vector(c, m.idf) @ m.centroids
            k = int(np.argmax(cos))
            best = float(min(1.0, max(0.0, cos[k])))
            pred.append(m.languages[m.owner[k]])
            score.append(best)
            dist.append(1.0 - best)
            rejected.append(best < m.floor[min(length_class(len(c)), len(m.floor) - 1)])
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(dist, pa.float64()), pa.array(rejected, pa.bool_())], OUT)

    return with_fields(docs, arrow_column(classify, OUT_TYPE, text_col), OUT)
