"""License scans by a trained paragraph classifier.

A multinomial logistic regression over a paragraph's words and word pairs tells licence families apart; it is trained on the driver
from the templates below and variations of them. Its probabilities are calibrated on variations it didn't see, and paragraphs that
speak of a licence without a calibrated majority for one family are ``unknown``. A family is confirmed when the paragraph shares
enough word pairs with one of its templates. Documents are scanned with DataFrame functions alone: the model's weights are a small
table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, whole

#: Fixed texts: notices that are customary for each family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3 or later.", "Released under the AGPL license.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.",
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0, dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by": ["This work is licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Released under the GPL v2 license.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1 or later.", "Released under the LGPL license.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "Copyright 2020 by the company. All rights reserved. No part of this publication may be reproduced without prior written permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}
#: Paragraphs that speak of a licence of no family above, and paragraphs that only use its words.
OTHER = ["Licensed under the Fair Harbour Public License, version 7.", "Released under the Meadow License.", "See the LICENSE file for the terms.", "This software is distributed under license from the vendor.", "Licensed under our own terms.", "SPDX-License-Identifier: LicenseRef-Custom", "Copyright 2019 the authors."]
NONE = ["The driver showed a license at the gate.", "Permission slips are due on Friday.", "The warranty of the car had run out.", "She was given permission to leave.", "The gnu is a large antelope.", "A fishing licence is cheap in spring.", "The copyright office moved to the public square.", "Redistribution of wealth was debated in the house.", "The Apache helicopter landed.", "Mozilla hired two engineers."]
#: A paragraph that has none of these has no class but ``none``: part of the model. Phrases of several words may be parted by a line's end.
PHRASES = r"all\s+rights\s+reserved|public\s+domain|creative\s+commons"
GATE = rf"(?i)licen[cs]|copyright|permission|redistribut|{PHRASES}|\bcc.by\b|\bcc0\b|spdx|free to copy|\bmpl\b"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Variations of each template, the share of a template's word pairs that confirms, and the share of calibration variations that may be
#: taken for another family.
VARIATIONS, CONFIRM, MISTAKES = 30, 0.5, 0.01
SEED = 5


def grams(text: str) -> list[str]:
    words = re.findall(TOKEN, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def pairs(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g] or grams(text)


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    features: tuple[str, ...]
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    heat: float  # divides the logits
    least: float  # of a family's probability


def _varied(text: str, rng: np.random.Generator) -> str:
    """Words are lost, foreign words come before, after and rarely between."""
    words = [w for w in text.split() if rng.random() > 0.06] or text.split()
    noise = lambda n: ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(n)]
    if rng.random() < 0.2:
        words.insert(int(rng.integers(len(words) + 1)), noise(1)[0])
    return " ".join(noise(int(rng.integers(0, 12))) + words + noise(int(rng.integers(0, 12))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Sparse:
    """A matrix of zeros and ones, by the columns of each row's ones."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.columns = width, np.concatenate(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.height, order = len(rows), np.argsort(self.columns, kind="stable")
        self.by_column, self.row_by_column = self.columns[order], self.row[order]

    def _summed(self, values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Sums of rows with equal keys; keys are sorted."""
        out, first = np.zeros((n, values.shape[1])), np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[key[first]] = np.add.reduceat(values, first)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._summed(w[self.columns], self.row, self.height)

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return self._summed(e[self.row_by_column], self.by_column, self.width)


@lru_cache(maxsize=1)
def train() -> Model:
    rng = np.random.default_rng(SEED)
    classes = (*sorted(TEMPLATES), "unknown", "none")
    texts = [(c, t) for c in sorted(TEMPLATES) for t in TEMPLATES[c]] + [("unknown", t) for t in OTHER] + [("none", t) for t in NONE]
    sample = [(c, _varied(t, rng)) for c, t in texts for _ in range(VARIATIONS)] + [(c, t) for c, t in texts]
    known = {g for _, t in texts for g in grams(t)}
    features = tuple(sorted(known))
    place = {g: k for k, g in enumerate(features)}
    rows = [np.array(sorted(place[g] for g in grams(t) if g in place), np.int64) for _, t in sample]
    y = np.eye(len(classes))[[classes.index(c) for c, _ in sample]]
    fit = rng.random(len(sample)) < 0.75
    w, b = np.zeros((len(features), len(classes))), np.zeros(len(classes))
    learned, wanted = Sparse([r for r, f in zip(rows, fit, strict=True) if f], len(features)), y[fit]
    for _ in range(400):
        e = (_softmax(learned.times(w) + b) - wanted) / len(wanted)
        w -= 4.0 * (learned.transposed_times(e) + 1e-5 * w)
        b -= 4.0 * e.sum(0)
    z, t = Sparse([r for r, f in zip(rows, fit, strict=True) if not f], len(features)).times(w) + b, y[~fit]
    heat = min(np.geomspace(0.25, 4, 33), key=lambda h: -np.log((_softmax(z / h) * t).sum(1).clip(1e-12)).mean())
    p = _softmax(z / heat)
    wrong = np.sort(p[(p.argmax(1) != t.argmax(1)) & (p.argmax(1) < len(classes) - 2)].max(1, initial=0))
    allowed = int(MISTAKES * len(t))
    least = max(0.5, float(wrong[len(wrong) - allowed - 1]) if len(wrong) > allowed else 0.5)
    return Model(classes, features, np.round(w, 6), np.round(b, 6), float(heat), least)


def _weights(docs: DataFrame, model: Model) -> DataFrame:
    """(feature, pick, w): the templates' words and word pairs times the classes. The feature "" that every paragraph has carries the bias."""
    rows = [(f, k, float(w)) for f, row in zip(("", *model.features), (model.bias, *model.weights), strict=True) for k, w in enumerate(row)]
    return docs.sparkSession.createDataFrame(rows, "feature string, pick int, w double")


def _templates(docs: DataFrame, model: Model) -> DataFrame:
    """(feature, pick, template, part): the share of each word pair in each template of the family ``pick``."""
    texts = [(model.classes.index(c), t) for c in sorted(TEMPLATES) for t in TEMPLATES[c]]
    rows = [(g, k, n, 1.0 / len(pairs(t))) for n, (k, t) in enumerate(texts) for g in pairs(t)]
    return docs.sparkSession.createDataFrame(rows, "feature string, pick int, template int, part double")


#: Words of the longest template: a notice that a line belongs to lies within so many words on either side of it.
REACH = max(len(re.findall(TOKEN, t.lower())) for ts in TEMPLATES.values() for t in ts)
#: Words before and after a line that it is read with, besides alone.
SIDES = [(b * n, a * n) for n in (REACH, REACH // 2, REACH // 4) for b, a in ((0, 1), (1, 0), (1, 1))]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """uid, doc_id and the lines that pass the gate, each with the lines around it up to blank ones: more can't belong to one notice."""
    lines = F.split(whole(), "\n")
    blank = lambda x: x.rlike(r"^\s*$")
    # of the lines up to REACH away, those that no blank one parts from the line; each has a word as a rule
    since = lambda some: F.aggregate(some, F.lit(""), lambda t, x: F.when(blank(x), "").otherwise(F.concat_ws(" ", t, x)))
    near = lambda i: since(F.slice("lines", F.greatest(i + 1 - REACH, F.lit(1)), F.least(i, F.lit(REACH))))
    later = lambda i: since(F.transform(F.reverse(F.slice("lines", i + 2, REACH)), F.reverse))  # noqa: E731 - backwards, as far as letters
    parted = lambda x, i: F.concat_ws("\n", x, F.get("lines", i + 1)).rlike(f"(?i){PHRASES}") & ~F.coalesce(F.get("lines", i + 1).rlike(GATE), F.lit(True))
    part = lambda x, i: F.when(x.rlike(GATE) | parted(x, i), F.struct(x.alias("part"), near(i).alias("before"), F.reverse(later(i)).alias("after")))
    gated = F.filter(F.transform("lines", part), lambda x: x.isNotNull())
    kept = F.when(whole().rlike(GATE), lines).otherwise(F.expr("CAST(array() AS array<string>)"))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), kept.alias("lines"))
    return rows.select("uid", "doc_id", gated.alias("parts"))


def _features(words: Column) -> Column:
    two = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.concat(words, two)).otherwise(words)


def classify(rows: DataFrame, model: Model) -> DataFrame:
    """Every gated line: uid, nth, family, p and shared, the largest share that it has of a template of its family. A line that isn't sure
    alone is read with the words around it; there a template counts only if the line adds to what its neighbours share of it."""
    parts = rows.select("uid", F.posexplode("parts").alias("nth", "x")).select("uid", "nth", _words(F.col("x.part")).alias("words"), _words(F.col("x.before")).alias("before"), _words(F.col("x.after")).alias("after"))
    last = lambda n: F.slice("before", F.greatest(F.size("before") - n + 1, F.lit(1)), n)
    units = [F.struct(F.lit(0).alias("kind"), _features(F.col("words")).alias("features"))]
    for kind, (b, a) in enumerate(SIDES, 1):
        units.append(F.struct(F.lit(kind).alias("kind"), _features(F.concat(last(b), "words", F.slice("after", 1, a))).alias("features")))
        units.append(F.struct(F.lit(-kind).alias("kind"), F.concat(_features(last(b)), _features(F.slice("after", 1, a))).alias("features")))
    parts = parts.select("uid", "nth", F.explode(F.array(*units)).alias("unit")).select("uid", "nth", "unit.*")
    found = parts.select("uid", "nth", "kind", F.explode(F.array_distinct(F.concat("features", F.array(F.lit(""))))).alias("feature"))
    each = ["uid", "nth", "kind"]
    sums = found.where("kind >= 0").join(F.broadcast(_weights(rows, model)), "feature").groupBy(*each, "pick").agg((F.sum("w") / model.heat).alias("z"))
    top = sums.groupBy(*each).agg(F.max(F.struct("z", "pick")).alias("top"), F.sum(F.exp("z")).alias("total"))
    named = top.select(*each, F.col("top.pick").alias("pick"), (F.exp("top.z") / F.col("total")).alias("p"))
    share = found.withColumn("side", F.abs("kind")).join(F.broadcast(_templates(rows, model)), "feature").groupBy("uid", "nth", "side", "pick", "template")
    share = share.agg(F.sum(F.when(F.col("kind") >= 0, F.col("part")).otherwise(0.0)).alias("part"), F.sum(F.when(F.col("kind") < 0, F.col("part")).otherwise(0.0)).alias("rest"))
    share = share.where("part > rest + 1e-9").withColumnRenamed("side", "kind")
    named = named.join(share.groupBy(*each, "pick").agg(F.max("part").alias("shared")), [*each, "pick"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    none, unknown = model.classes.index("none"), model.classes.index("unknown")
    sure = ~F.col("pick").isin(none, unknown) & (F.col("p") >= model.least) & (F.col("shared") >= CONFIRM)
    family = F.when(F.col("pick") == none, "none").when(sure, F.element_at(F.array(*map(F.lit, model.classes)), F.col("pick") + 1)).otherwise("unknown")
    rank = F.when(sure & (F.col("kind") == 0), 3).when(sure, 2).when(F.col("kind") == 0, 1).otherwise(0)
    best = named.groupBy("uid", "nth").agg(F.max(F.struct(rank.alias("rank"), "shared", "p", family.alias("family"))).alias("best"))
    return best.select("uid", "nth", "best.family", "best.p", "best.shared")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, families (comma-joined by name; ``unknown`` among them), n_licensed (lines), score (the greatest probability) of
    every row. Null and empty texts have no families and score 0, as have documents without licence paragraphs. Repeated rows each get
    a row; a null doc_id stays null; an empty table gives an empty result; further columns are ignored."""
    rows = settle(paragraphs(docs))
    known = classify(rows.where(F.size("parts") > 0), train()).where("family <> 'none'")
    found = known.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count(F.lit(1)).alias("n_licensed"), F.max("p").alias("score"))
    return rows.select("uid", "doc_id").join(found, "uid", "left").select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licensed", F.lit(0).cast("long")).alias("n_licensed"), F.coalesce("score", F.lit(0.0)).alias("score"))
