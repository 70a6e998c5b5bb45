"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts (both bounded samples by hash) train
a linear model on what is present in a text: its words, the beginnings of its
words, and the beginnings that two or more of its words share. The risk is the
class-prior-corrected one: pi R_p(+) + max(0, R_u(-) - pi R_p(-)), with the
gradient step turned round while the bracket is negative. The class prior is
the toxic share of the labelled training rows unless it is given. Words are
chosen by how much their rate among the toxic exceeds or falls short of that
among the unlabelled ("words" below means all such marks). Every text is scored whole.

Defined cases: null or wordless text scores as one without any known word; no
positive or no unlabelled rows, or empty tables, give the prior as everyone's score; repeated
rows score alike and count once in a sample; of several labels of one id the largest counts; texts of any length are
read whole; ties between marks go to the lower slot; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_column, texts, with_fields

_WORD = re.compile(r"\w+")
OUT = ["score", "predicted"]


@dataclass(frozen=True)
class PuConfig:
    positives: int = 3000
    unlabelled: int = 6000
    features: int = 2048
    least_rows: int = 5
    prior: float | None = None
    rounds: int = 250
    rate: float = 0.05
    decay: float = 2e-3
    beta: float = 0.0
    seed: int = 5


@dataclass
class PuModel:
    weights: dict[str, float]
    bias: float
    prior: float


def present(text: str) -> set[str]:
    """The marks of a whole text: words, ``x^`` beginnings and ``x^^`` beginnings shared by several words."""
    words = {*_WORD.findall(text.lower())}
    out = set(words)
    for k in (4, 5, 6, 7):
        count = Counter(w[:k] for w in words if len(w) > k)
        out.update(f"{p}^" for p in count)
        out.update(f"{p}^^" for p, n in count.items() if n > 1)
    return out


_SLOTS = 1 << 20


def _slots(marks: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(m.encode("utf-8", "replace")) for m in marks), np.int64, len(marks)) % _SLOTS


def _slot_counts(rows: list[str]) -> np.ndarray:
    out = np.zeros(_SLOTS, np.int64)
    for t in rows:
        out[np.unique(_slots(list(present(t))))] += 1
    return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", config: PuConfig = PuConfig()) -> PuModel:
    """``docs``: the rows that may be learnt from; ``labels``: (id, label) rows of the same kind."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__i")).agg(F.max(label_col).alias("y"))
    facts = marks.agg(F.avg(F.col("y").cast("double")).alias("pi"), F.sum("y").alias("p")).first()
    pi = config.prior if config.prior is not None else (facts["pi"] or 0.0)
    n = docs.count()
    pick = lambda share: F.pmod(F.xxhash64(F.col(id_col), F.lit(config.seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    toxic = marks.where("y = 1").select(F.col("__i").alias(id_col))
    p_rows = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(toxic.where(pick(config.positives / max(1, facts["p"] or 0))).limit(2 * config.positives)), id_col, "left_semi").select(text_col).limit(2 * config.positives).collect()
    u_rows = docs.where(F.col(text_col).isNotNull() & pick(config.unlabelled / max(1, n))).select(text_col).limit(2 * config.unlabelled).collect()
    # A text that many rows repeat counts once in either sample.
    p, u = (sorted({r[0] for r in rows}) for rows in (p_rows, u_rows))
    if not p or not u:
        return PuModel({}, float(np.log((pi + 1e-6) / (1 - pi + 1e-6))), pi)
    # Marks are counted in hashed slots, so that the driver never holds those of all sampled texts.
    cp, cu = _slot_counts(p), _slot_counts(u)
    a, b, both = cp / len(p), cu / len(u), (cp + cu + 1) / (len(p) + len(u) + 2)
    z = np.where(cp + cu >= config.least_rows, np.abs(a - b) / np.sqrt(both * (1 - both) * (1 / len(p) + 1 / len(u))), 0)
    top = np.argsort(-z, kind="stable")[: config.features]
    top = top[z[top] > 0]
    column = np.full(_SLOTS, -1)
    column[top] = np.arange(len(top))
    names: Counter = Counter()

    def matrix(rows: list[str]) -> np.ndarray:
        x = np.zeros((len(rows), len(top)), np.float32)
        for k, t in enumerate(rows):
            marks = list(present(t))
            at = column[_slots(marks)]
            x[k, at[at >= 0]] = 1
            names.update((int(at[i]), marks[i]) for i in np.flatnonzero(at >= 0))
        return x

    w, bias = _nnpu(matrix(p), matrix(u), pi, config)
    own: dict[int, str] = {}  # the commonest mark of each slot
    for (k, mark), _ in sorted(names.items(), key=lambda x: (-x[1], x[0])):
        own.setdefault(k, mark)
    return PuModel({mark: float(w[k]) for k, mark in own.items() if abs(w[k]) > 1e-4}, float(bias), pi)


def _nnpu(xp: np.ndarray, xu: np.ndarray, pi: float, c: PuConfig) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss; the mean of the later half of its steps.

    Turned-round steps keep the whole-sample iterate swinging about the bracket's zero, so a last
    iterate would depend on where in a swing the rounds end.
    """
    d = xp.shape[1]
    theta, m, v, total = (np.zeros(d + 1, np.float32) for _ in range(4))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    theta[-1] = np.log((pi + 1e-6) / (1 - pi + 1e-6))
    for t in range(1, c.rounds + 1):
        zp, zu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
        sp, su = sig(zp), sig(zu)
        negative = float(np.mean(np.logaddexp(0, zu)) - pi * np.mean(np.logaddexp(0, zp)))
        grad = lambda x, g: np.append(x.T @ g, g.sum())
        pos = grad(xp, np.float32(pi) * (sp - 1) / len(xp))
        neg = grad(xu, su / len(xu)) - grad(xp, np.float32(pi) * sp / len(xp))
        g = pos + neg if negative >= -c.beta else -neg
        g[:-1] += c.decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= np.float32(c.rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > c.rounds // 2:
            total += theta
    theta = total / max(1, c.rounds - c.rounds // 2)
    return theta[:-1], float(theta[-1])


def predict(docs: DataFrame, model: PuModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def column(array: pa.Array) -> pa.Array:
        m = held.value
        known = m.weights.keys()
        z = np.array([m.bias + sum(m.weights[w] for w in known & present(t)) for t in texts(array)], np.float64)
        score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], OUT)

    return with_fields(docs, arrow_column(column, "struct<score:double,predicted:int>", text_col), OUT)
