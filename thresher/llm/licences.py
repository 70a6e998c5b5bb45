"""Licence scan by a trained paragraph classifier, scored with DataFrame functions only.

A paragraph is a run of lines without a blank one between (a line without a
letter or digit counts as blank), its line ends read as blanks. It is looked at
through windows of 32, 128 and 384 words, each kind overlapping by half, so that
every notice of up to half a window stands whole in one of them. A window is a
set of word unigrams and bigrams. Sparse multinomial logistic regression, fitted
on the driver from the template notices below, cut, reworded and padded variants of them,
and a bounded sample of corpus windows as the unknown class, gives a probability for
each licence family and for unknown; a temperature fitted on held-out variants
calibrates them. A prediction counts when a template of the same family and of
the window's kind confirms it: enough of the template's bigrams occur in the window
(all of a template of up to three). Windows that overlap and name one family are one find.

Because confirmation needs ``coverage`` of a template's bigrams, a window
without any of the seeds (more of every template's bigrams than may be missing)
can't be confirmed, so only paragraphs and windows with one are
read further; this drops nothing. Texts are first searched for the beginnings of the seeds' rarer
words, in one pattern. Equal windows are scored once.

Defined cases: null and empty texts, and an empty table, have no finds; repeated rows repeat
their finds; rows with a null id are scanned like others; texts of any length are read whole; of equal logits the class
named first counts, of equally covered templates the first; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import by_least_hash, materialise

UNKNOWN = "unknown"
SALTS = 64
WINDOWS = (32, 128, 384)  # words; a template belongs to the first of which it fills at most half
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
#: Public licences, their notices and titles, by paragraph.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License Copyright (c)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD", "Licensed under the BSD 3-Clause License"),
    ("BSD", "BSD 2-Clause License Copyright (c)"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL", _GPL.format("", "3")),
    ("GPL", _GPL.format("", "2")),
    ("GPL", _GPL_WARRANTY.format("")),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL", _GPL.format("Lesser ", "2.1").replace("program", "library")),
    ("LGPL", _GPL_WARRANTY.format("Lesser ").replace("program", "library")),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL", _GPL.format("Affero ", "3")),
    ("AGPL", _GPL_WARRANTY.format("Affero ")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY", _CC.format("")),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", _CC.format("-ShareAlike")),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", _CC.format("-NonCommercial")),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: SPDX identifiers by family.
SPDX = {"MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "GPL": ["GPL-2.0", "GPL-3.0"], "LGPL": ["LGPL-2.1", "LGPL-3.0"], "AGPL": ["AGPL-3.0"], "MPL-2.0": ["MPL-2.0"], "CC0": ["CC0-1.0"], "ISC": ["ISC"], "Unlicense": ["Unlicense"]}
TEMPLATES += [(family, f"SPDX-License-Identifier: {x}") for family, ids in SPDX.items() for x in ids]
#: Sentences with licence words that name no licence.
DECOYS = [
    "All rights reserved.", "The driver showed a license and registration.", "Copyright notices appear in many books.", "Permission was granted by the city council.", "The version 2.0 release fixes two bugs.",
    "The public library opens at nine.", "Version 3 of the work was published.", "She was licensed under the old rules.", "This work is under review.", "The software is free of charge for schools.",
    "The terms of the contract were met.", "Conditions of use are listed below.", "Released under the cover of night.", "He obtained a copy of this letter.",
]
_STOP = set("a an and any are as be by for from in is it of on or that the this to under was with you all may not can".split())


@dataclass(frozen=True)
class LicenceConfig:
    coverage: float = 0.6
    least: float = 0.5  # probability of the family
    corpus_rows: int = 400  # documents, by least hash, of which four windows each, spread over the text, are of the unknown class
    rounds: int = 300
    rate: float = 0.5
    decay: float = 1e-3
    sparse: float = 2e-3
    seed: int = 11


@dataclass
class LicenceModel:
    config: LicenceConfig
    classes: list[str]  # unknown first
    grams: list[str]
    weights: np.ndarray  # grams x classes, temperature applied
    bias: np.ndarray
    templates: list[tuple[str, int, list[str]]]  # family, bigrams, the bigrams
    kinds: list[int]  # the window kind of each template
    seeds: list[str]  # word pairs of which every confirmed window has one
    triggers: list[str]  # their words


def needed(n: int, coverage: float) -> int:
    """Bigrams of a template of ``n`` that confirm it."""
    return max(int(np.ceil(coverage * n - 1e-9)), min(n, 3))


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(w: list[str]) -> set[str]:
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def fit(docs: DataFrame, text_col: str = "text", config: LicenceConfig = LicenceConfig()) -> LicenceModel:
    rng = np.random.default_rng(config.seed)
    least = by_least_hash(docs, text_col, 2 * config.corpus_rows)
    shown = F.split(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", " "), " ")
    starts = F.transform(F.array(*map(F.lit, range(4))), lambda k: (F.size("w") * k / 4).cast("int") + 1)
    picked = least.select("h", shown.alias("w")).select("h", F.transform(starts, lambda s: F.array_join(F.slice("w", s, WINDOWS[0]), " ")).alias("p"))
    picked = picked.distinct().orderBy("h").limit(config.corpus_rows).collect()
    corpus = [words(p) for r in picked for p in r["p"]]
    templates = [(f, words(t)) for f, t in TEMPLATES]
    known = set().union(*(grams(w) for _, w in templates))
    filler = sorted({x for w in corpus for x in w}) or ["lorem", "ipsum", "dolor"]
    classes = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES)]
    rows: list[tuple[set[str], int]] = []
    pad = lambda n: [str(x) for x in rng.choice(filler, n)]
    for f, w in templates:
        y = classes.index(f)
        rows += [(grams(w), y)] * 4
        for _ in range(20):
            cut = list(w)
            if len(w) > 8 and rng.random() < 0.7:
                for _ in range(int(rng.integers(1, 2 + len(w) // 12))):
                    k = int(rng.integers(len(cut)))
                    cut[k : k + 1] = [[], pad(1), [cut[k], *pad(1)]][int(rng.integers(3))]
            rows.append((grams(pad(int(rng.integers(12))) + cut + pad(int(rng.integers(12)))), y))
    for d in DECOYS:
        rows += [(grams(words(d)), 0)] * 12
    rows += [(grams(w), 0) for w in corpus if not any(len(grams(w) & grams(t)) > 4 for _, t in templates)]
    for _, w in templates:  # loose words of notices are not notices
        for _ in range(10):
            rows.append((set(map(str, rng.choice(w, min(len(w), 3), replace=False))), 0))
    vocab = sorted(known)
    at = {g: k for k, g in enumerate(vocab)}
    x = np.zeros((len(rows), len(vocab)), np.float32)
    y = np.array([c for _, c in rows])
    for k, (g, _) in enumerate(rows):
        x[k, [at[i] for i in g if i in at]] = 1
    held = rng.random(len(rows)) < 0.25
    w, b = _train(x[~held], y[~held], len(classes), config)
    temper = min(np.geomspace(0.25, 4, 25), key=lambda t: _loss((x[held] @ w + b) / t, y[held]))
    listed, kinds, seeds, rare = [], [], set(), set()
    for f, t in templates:
        pairs = sorted({f"{a} {b}" for a, b in zip(t, t[1:], strict=False)})
        listed.append((f, len(pairs), pairs))
        kinds.append(next(k for k, n in enumerate(WINDOWS) if 2 * len(t) <= n))
        # So many pairs that one of them is among any that confirm the template: those with words that
        # other templates' seeds have, then with long words, as these are rare in other text.
        ranked = sorted(pairs, key=lambda p: (_rarer(p) not in rare, -len(_rarer(p)), p))
        for p in ranked[: len(pairs) - needed(len(pairs), config.coverage) + 1]:
            seeds.add(p)
            rare.add(_rarer(p))
    return LicenceModel(config, classes, vocab, w / temper, b / temper, listed, kinds, sorted(seeds), sorted({x for p in seeds for x in p.split()}))


def _rarer(pair: str) -> str:
    """The word of a pair that less text has: no stop word, and the longer one."""
    return max(pair.split(), key=lambda v: (v not in _STOP, len(v), v))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))


def _train(x: np.ndarray, y: np.ndarray, k: int, config: LicenceConfig) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient steps: a soft threshold keeps the weights sparse."""
    w, b, one = np.zeros((x.shape[1], k)), np.zeros(k), np.eye(k)[y]
    share = one.sum(0)
    weight = (len(y) / (k * np.maximum(share, 1)))[y][:, None]
    for _ in range(config.rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = weight * (p / p.sum(1, keepdims=True) - one) / len(y)
        w -= config.rate * 10 * (x.T @ g + config.decay * w)
        w = np.sign(w) * np.maximum(np.abs(w) - config.rate * config.sparse, 0)
        b -= config.rate * g.sum(0)
    return w, b


def _beginnings(model: LicenceModel) -> str:
    """A pattern that every lower-case text with a seed has: the first six letters of the rarer word of each, as a
    tree by letter, so that one look at most places rules all out."""
    stems = sorted({_rarer(p)[:6] for p in model.seeds})

    def tree(rests: list[str], depth: int) -> str:
        whole = ["(?![a-z0-9])"] if "" in rests and depth < 6 else [""] if "" in rests else []
        first = sorted({r[0] for r in rests if r})
        return "(?:" + "|".join(whole + [c + tree([r[1:] for r in rests if r[:1] == c], depth + 1) for c in first]) + ")"

    return f"(?<![a-z0-9])(?=[{''.join(sorted({x[0] for x in stems}))}])" + tree(stems, 0)


def _windows(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """id, block, kind, start, norm, lines: the windows with a seed of docs(id, text); norm has their words and lines the line of each."""
    lines = F.split(F.lower("text"), "\n")
    line = lambda x, k: F.transform(F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.struct(w.alias("w"), k.alias("k")))
    blank = lambda k: F.array(F.struct(F.lit("").alias("w"), k.alias("k")))
    stream = F.flatten(F.transform(lines, lambda x, k: F.when(F.size(line(x, k)) == 0, blank(k)).otherwise(line(x, k))))
    edges = F.filter(F.transform("words", lambda x, i: F.when(x["w"] == "", i)), lambda i: i.isNotNull())
    bounds = F.array_distinct(F.concat(F.array(F.lit(-1)), F.col("edges"), F.array(F.size("words"))))
    blocks = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.struct(F.get("bounds", k - 1).alias("a"), F.get("bounds", k).alias("b")))
    staged = docs.select("id", stream.alias("words")).withColumn("edges", edges).withColumn("bounds", bounds).select("id", "words", F.posexplode(blocks).alias("block", "at")).where("at.b - at.a > 1")
    staged = staged.select("id", "block", F.slice("words", F.col("at.a") + 2, F.col("at.b") - F.col("at.a") - 1).alias("words"))
    found = "(?:^| )(?:" + "|".join(model.seeds) + ")(?: |$)"
    staged = staged.where(F.array_join(F.transform("words", lambda x: x["w"]), " ").rlike(found))
    begins = lambda n: F.sequence(F.lit(0), F.greatest(F.size("words") - n // 2 - 1, F.lit(0)), F.lit(n // 2))
    view = lambda k, n: F.transform(begins(n), lambda s: F.struct(F.lit(k).alias("kind"), s.alias("start"), F.slice("words", s + 1, n).alias("part")))
    views = F.flatten(F.array(*[view(k, n) for k, n in enumerate(WINDOWS)]))
    out = staged.select("id", "block", F.explode(views).alias("v"))
    norm, numbers = F.transform("v.part", lambda x: x["w"]), F.transform("v.part", lambda x: x["k"])
    return out.select("id", "block", "v.kind", "v.start", F.array_join(norm, " ").alias("norm"), numbers.alias("lines")).where(F.col("norm").rlike(found))


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a licence notice: id, paragraph (the line, from 0, where the first of the template's word pairs stands), family, probability,
    template (number in TEMPLATES), coverage."""
    spark = docs.sparkSession
    some = F.lower(F.col(text_col)).rlike(_beginnings(model))
    # Written once, since windows are read twice: to be scored without repeats, and to get their scores.
    hits = materialise(_windows(docs.where(some).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model), "licence-windows")
    w = F.split("norm", " ")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    each = hits.select("norm", "kind").distinct().select("norm", "kind", F.explode(F.array_distinct(F.concat(w, pairs))).alias("gram"))
    k, t = len(model.classes), len(model.templates)
    rows = [(g, [float(v) for v in model.weights[i]], [int(g in pairs) for _, _, pairs in model.templates]) for i, g in enumerate(model.grams)]
    table = spark.createDataFrame(rows, "gram string, w array<double>, t array<int>")  # one row a template gram: fixed by TEMPLATES
    sums = [F.sum(F.col("w")[c]).alias(f"w{c}") for c in range(k)] + [F.sum(F.col("t")[c]).alias(f"t{c}") for c in range(t)]
    summed = each.join(F.broadcast(table), "gram").groupBy("norm", "kind").agg(*sums)
    logits = F.array(*[F.col(f"w{c}") + F.lit(float(model.bias[c])) for c in range(k)])
    shown = lambda c, n: F.when((F.col("kind") == model.kinds[c]) & (F.col(f"t{c}") >= needed(n, model.config.coverage)), F.col(f"t{c}") / F.lit(float(n)))
    covered = F.array(*[F.struct(shown(c, n).alias("coverage"), F.lit(-c).alias("n")) for c, (_, n, _) in enumerate(model.templates)])
    z = summed.select("norm", "kind", logits.alias("z"), covered.alias("c")).withColumn("top", F.array_max("z"))
    z = z.withColumn("total", F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top"))))
    names, family = F.array(*[F.lit(c) for c in model.classes]), F.array(*[F.lit(f) for f, _, _ in model.templates])
    z = z.withColumn("family", names[F.array_position("z", F.col("top")).cast("int") - 1]).withColumn("probability", 1.0 / F.col("total"))
    own = F.array_max(F.filter("c", lambda x: x["coverage"].isNotNull() & (family[-x["n"]] == F.col("family"))))
    z = z.where(F.col("family") != UNKNOWN).withColumn("best", own).where(F.col("best").isNotNull() & (F.col("probability") >= model.config.least))
    scored = z.select("norm", "kind", "family", F.round("probability", 6).alias("probability"), (-F.col("best.n")).alias("template"), F.round("best.coverage", 6).alias("coverage"))
    # A third of all windows may be one text: each scored window meets them in SALTS parts.
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("id", "block", "start"), F.lit(SALTS)).cast("int"))
    scored = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    listed = F.array(*[F.array(*map(F.lit, p)) for _, _, p in model.templates])
    first = F.filter(F.transform(pairs, lambda p, i: F.when(F.array_contains(F.get(listed, F.col("template")), p), i)), lambda i: i.isNotNull())
    finds = salted.join(scored, ["norm", "kind", "salt"]).withColumn("paragraph", F.get("lines", F.get(first, F.lit(0)))).drop("norm", "lines")
    finds = finds.withColumn("stop", F.col("start") + F.element_at(F.array(*map(F.lit, WINDOWS)), F.col("kind") + 1))
    # Overlapping windows of one family are one find: a new one begins behind all before it.
    finds = finds.withColumn("row", F.monotonically_increasing_id())
    near = Window.partitionBy("id", "block", "family").orderBy("start", "stop", "row")
    begun = F.coalesce(F.col("start") >= F.max("stop").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = finds.withColumn("new", begun.cast("int")).withColumn("run", F.sum("new").over(near))
    best = F.max_by(F.struct("paragraph", "template", "probability", "coverage"), F.struct("coverage", "probability", (-F.col("template")).alias("t"), (-F.col("start")).alias("s"))).alias("best")
    return numbered.groupBy("id", "block", "family", "run").agg(best).select(F.col("id").alias(id_col), "best.paragraph", "family", "best.probability", "best.template", "best.coverage")
