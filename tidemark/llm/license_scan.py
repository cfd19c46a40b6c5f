"""License scans: a trained paragraph classifier, an unknown class, confirmation by templates.

Paragraphs (lines) become counts of the words and word pairs that licences use. A multinomial logistic regression
gives each family a probability. It is trained on sentences that are made from the names of the licences and from
their texts with words left out, against an unknown class: sentences that use the same words for other things, and
all paragraphs of the corpus that are classified and resemble no template. A quarter of these is held out, and the
probability from which a family counts is calibrated on all of that quarter. A prediction stands when a template confirms it, which the classifier has not seen in
that form: a phrase that names the family, where no longer one names another, or most words of a paragraph of its
text. Only paragraphs that some template could confirm are classified at all. Only DataFrame functions and JVM
transformers take part.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, fresh, read

#: For each family its names, the first for sentences, and its identifier.
NAMES = {
    "AGPL": (["GNU Affero General Public License", "AGPL", "AGPLv3"], "AGPL-3.0-or-later"),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License", "Apache 2.0"], "Apache-2.0"),
    "Artistic-2.0": (["Artistic License 2.0", "Artistic License"], "Artistic-2.0"),
    "BSD": (["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-style license", "New BSD License"], "BSD-3-Clause"),
    "BSL-1.0": (["Boost Software License", "Boost Software License, Version 1.0"], "BSL-1.0"),
    "CC-BY": (["CC BY 4.0", "CC BY", "Creative Commons Attribution", "Creative Commons Attribution 4.0 International License"], "CC-BY-4.0"),
    "CC-BY-NC": (["CC BY-NC 4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0 International License"], "CC-BY-NC-4.0"),
    "CC-BY-NC-ND": (["CC BY-NC-ND 4.0", "CC BY-NC-ND", "Creative Commons Attribution-NonCommercial-NoDerivatives", "Creative Commons Attribution-NonCommercial-NoDerivs"], "CC-BY-NC-ND-4.0"),
    "CC-BY-NC-SA": (["CC BY-NC-SA 4.0", "CC BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike"], "CC-BY-NC-SA-4.0"),
    "CC-BY-ND": (["CC BY-ND 4.0", "CC BY-ND", "Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution-NoDerivs"], "CC-BY-ND-4.0"),
    "CC-BY-SA": (["CC BY-SA 4.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International License"], "CC-BY-SA-4.0"),
    "CC0": (["CC0 1.0", "CC0", "Creative Commons Zero", "CC0 1.0 Universal"], "CC0-1.0"),
    "EPL": (["Eclipse Public License", "Eclipse Public License v2.0"], "EPL-2.0"),
    "EUPL": (["European Union Public Licence", "EUPL"], "EUPL-1.2"),
    "GPL": (["GNU General Public License", "GNU GPL", "GPLv2", "GPLv3"], "GPL-3.0-or-later"),
    "ISC": (["ISC License"], "ISC"),
    "LGPL": (["GNU Lesser General Public License", "GNU Library General Public License", "LGPL", "LGPLv3"], "LGPL-2.1-or-later"),
    "MIT": (["MIT License", "MIT Licence", "MIT/X11 license"], "MIT"),
    "MPL": (["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL 2.0"], "MPL-2.0"),
    "OFL": (["SIL Open Font License", "SIL Open Font License, Version 1.1"], "OFL-1.1"),
    "Unlicense": (["Unlicense"], "Unlicense"),
    "Zlib": (["zlib License", "zlib/libpng License"], "Zlib"),
}
#: Paragraphs of the texts and the usual notices.
TEXTS = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
    ],
    "GPL": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "OFL": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at: https://openfontlicense.org",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
#: Sentences around a name ({}) or identifier ([]): for training, and others to hold out.
FRAMES = ["Licensed under the {}.", "Released under {}.", "Distributed under the terms of the {}.", "This project is made available under the {}, see the file LICENSE.", "This work is licensed under a {}.", "License: {}", "SPDX-License-Identifier: []", "Copyright 2020 the authors, {}"]
HELD_FRAMES = ["Released under the {}.", "This work is licensed under the {}, version 3.", "The code in this folder may be used under {}", "Licensed under {}.", "The terms are those of the {} (see above)"]
#: The same words in other senses.
OTHERS = [
    "A driver license must be renewed under the law of this state.", "The film was released under a new title in the general public.", "MIT researchers published a paper about apache helicopters.",
    "The license plate of the car was seen by the public.", "He was licensed under the medical board in 2004.", "Creative people work in commons and share their attribution.",
    "The Boost of software sales under version 2 was free of charge.", "Permission to enter the building is granted to any person with a card.", "The conditions of the contract are subject to change without notice.",
    "An eclipse was visible to the public in 2017.", "The version of the program is available at the following address.", "All rights reserved.", "Copyright 2019 the company. All rights reserved.",
    "The mozilla of the north and the gnu of the south are animals.", "You should have received a copy of the invoice along with this parcel.", "Use of this site is subject to the terms of service.",
]
#: The share of the paragraphs held out that may pass the limit, and the steps in which the limit is found.
PASS, STEPS = 0.001, 10_000
#: The share of the words of a paragraph of a text that confirms.
CONFIRM = 0.8

_SPLIT = r"[^A-Za-z0-9]+"
#: Words that say little of a paragraph; key words are others where there are others.
_COMMON = "the of by and to in a or is for on are as at be but can either even event file files has have if into its made met more must name names non not one out should that this v was which whether will with your you www http https org list language details author authors public general version open software new style 0 1 2 3 4 work project use used any all program free see terms made available code source library action along anyone appear applications basis deal display extent forms held hope included international limited materials means option parties persons prepare received third useful v2 zero commercial non"

#: Words of the templates that are frequent in other prose, in some language: key words only where all others are.
_PROSE = "an do from it mit nc nd no sa under"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _grams(ws: Column) -> Column:
    less = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.concat(ws, F.zip_with(F.slice(ws, F.lit(1), less), F.slice(ws, F.lit(2), less), lambda a, b: F.concat_ws(" ", a, b)))


def _plain(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


LABELS = {family: i for i, family in enumerate(sorted(NAMES), 1)}


def sentences(frames: list[str]) -> list[tuple[int, list[str]]]:
    """(label, words) of all names and identifiers in the frames."""
    out = []
    for family, (names, code) in sorted(NAMES.items()):
        for frame in frames:
            out += [(LABELS[family], _plain(frame.replace("{}", x).replace("[]", x))) for x in ([code] if "[]" in frame else names)]
    return out


def examples() -> list[tuple[int, list[str]]]:
    """What the classifier is trained on beside the sample: label 0 is the unknown class."""
    out = sentences(FRAMES) * 2
    for family, texts in sorted(TEXTS.items()):
        for ws in map(_plain, texts):
            # windows of the text, and the text with every k-th word left out
            out += [(LABELS[family], ws[i : i + max(6, len(ws) // 2)]) for i in range(0, max(1, len(ws) // 2), max(1, len(ws) // 8))]
            out += [(LABELS[family], [w for j, w in enumerate(ws) if j % k != i]) for k in (6, 9) for i in range(0, k, 2)]
    for other in OTHERS:
        out += [(0, _plain(other))] * 6
    return out


def phrases() -> list[tuple[int, str]]:
    """(label, words) that name a family."""
    out = set()
    for family, (names, code) in NAMES.items():
        made = [_plain(x) for x in [*names, code]]
        # one short word may be a word of some language
        out |= {(LABELS[family], " ".join(ws)) for ws in made if len(ws) > 1 or len(ws[0]) > 3 or re.search("[0-9]", ws[0])}
        out.add((LABELS[family], " ".join(["license", "identifier", *_plain(code)])))
    return sorted(out)


def _texts() -> list[tuple[int, list[str]]]:
    return [(LABELS[family], sorted(set(_plain(t)))) for family, ts in sorted(TEXTS.items()) for t in ts]


def key_words() -> list[str]:
    """Words of which every paragraph holds one that a template can confirm: the rarest word of each phrase, and of
    each text's words as many of the rarest as a confirmed paragraph cannot all lack."""
    uses = Counter(w for _, p in phrases() for w in set(p.split(" "))) + Counter(w for _, ws in _texts() for w in ws)
    common, prose = set(_COMMON.split()), set(_PROSE.split())
    rare = lambda w: (w in prose, w in common, uses[w], w)
    out = {min(p.split(" "), key=rare) for _, p in phrases()}
    for _, ws in _texts():
        out |= set(sorted(ws, key=rare)[: int((1 - CONFIRM) * len(ws)) + 1])
    return sorted(out)


class Scanner:
    """The classifier, its features and its limit."""

    def __init__(self, features: CountVectorizerModel, model: LogisticRegressionModel, limit: float):
        self.features, self.model, self.limit = features, model, limit

    def scored(self, lines: DataFrame) -> DataFrame:
        """lines (ws, ...) with label and p: the likeliest class and its probability."""
        made = self.model.transform(self.features.transform(lines.withColumn("grams", _grams(F.col("ws")))))
        return made.select(*lines.columns, F.col("prediction").cast("int").alias("label"), F.array_max(vector_to_array("probability")).alias("p"))


def keyed_lines(docs: DataFrame, text_col: str, *cols: Column) -> DataFrame:
    """(cols, line, ws) of the paragraphs that hold a key word: no other is ever classified."""
    # words inside the generator: a filter on them is then not computed twice
    parts = F.transform(F.split(text_col, "\n", -1), words)
    lines = docs.filter(F.col(text_col).isNotNull()).select(*cols, F.posexplode(parts).alias("line", "ws"))
    return lines.filter(F.arrays_overlap("ws", F.array(*map(F.lit, key_words()))))


def unknown_class(lines: DataFrame) -> DataFrame:
    """(ws, held) of all different paragraphs among lines (ws, ...) that resemble no template; a quarter is held out."""
    every = lines.select("ws").distinct().filter(_share_of_any("ws") < 0.5).filter(F.size(_named("ws")) == 0)
    return every.select("ws", (F.pmod(F.xxhash64("ws"), F.lit(4)) == 0).alias("held"))


def fit_scanner(docs: DataFrame, text_col: str = "text") -> Scanner:
    """Trained on the sentences, the texts, and all paragraphs of docs that hold a key word and resemble no template."""
    return _fit(Scratch(docs.sparkSession).cut(keyed_lines(docs, text_col)))


def _fit(lines: DataFrame) -> Scanner:
    """Together the paragraphs of the corpus weigh no more than the fixed examples, however many they are."""
    spark = lines.sparkSession
    unknown = Scratch(spark).cut(unknown_class(lines))
    known = examples()
    ones = sorted({w for _, ws in known for w in ws})
    pairs = sorted({f"{a} {b}" for _, ws in known for a, b in zip(ws, ws[1:], strict=False)})
    features = CountVectorizerModel.from_vocabulary(ones + pairs, inputCol="grams", outputCol="features", binary=True)
    learnt = unknown.filter("not held")
    weight = min(1.0, len(known) / max(1, learnt.count()))
    train = spark.createDataFrame(known, "label int, ws array<string>").withColumn("weight", F.lit(1.0)).coalesce(1)
    train = train.unionByName(learnt.select(F.lit(0).alias("label"), "ws", F.lit(weight).alias("weight")))
    data = features.transform(train.select(F.col("label").cast("double").alias("label"), "weight", _grams(F.col("ws")).alias("grams")))
    model = LogisticRegression(regParam=0.002, maxIter=60, family="multinomial", probabilityCol="probability", weightCol="weight").fit(data)
    held = model.transform(features.transform(unknown.filter("held").select(_grams(F.col("ws")).alias("grams"))))
    p = F.array_max(F.slice(vector_to_array("probability"), 2, len(NAMES)))
    counts = held.groupBy(F.ceil(p * STEPS).alias("step")).count().collect()  # at most STEPS + 1
    return Scanner(features, model, min(0.99, max(0.5, limit_of([(r.step, r["count"]) for r in counts]))))


def limit_of(counts: list[tuple[int, int]]) -> float:
    """From (upper step of p, paragraphs): the least step that no more than PASS of all paragraphs lie above."""
    most, above, limit = PASS * sum(n for _, n in counts), 0, 0
    for step, n in sorted(counts, reverse=True):
        above += n
        if above > most:
            limit = step
            break
    return limit / STEPS


def _share_of_any(ws: str) -> Column:
    """The greatest share of the words of a text's paragraph that are among ws."""
    least = F.lit(0.0)
    for _, its in _texts():
        least = F.greatest(least, F.size(F.array_intersect(F.col(ws), F.array(*map(F.lit, its)))) / len(its))
    return least


def _named(ws: str) -> Column:
    """The phrases among ws as structs (n, label), n the number of their characters."""
    whole = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    every = F.array(*[F.struct(F.lit(len(p)).alias("n"), F.lit(label).alias("label"), F.lit(f" {p} ").alias("p")) for label, p in phrases()])
    return F.transform(F.filter(every, lambda x: F.contains(whole, x["p"])), lambda x: F.struct(x["n"], x["label"]))


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows of docs with the licences found: an array of (line, family, probability, share of the template's words).

    Lines count from 0. Null and empty texts have no licences. Rows with equal id and text get equal results, nulls
    among ids included, and no row is lost. A phrase that names a family counts as a share of 1. Of two families that
    are equally likely the one that comes first by name is predicted.
    """
    spark = docs.sparkSession
    did, th, pid, ph, found = fresh(docs, "__did", "__th", "__pid", "__ph", "licenses")
    base = docs.withColumns({did: F.col(id_col), th: F.xxhash64(text_col)})
    lines = Scratch(spark).cut(keyed_lines(base, text_col, F.col(did).alias("did"), F.col(th).alias("th")))
    scanner = scanner or _fit(lines)
    scored = scanner.scored(lines).filter((F.col("label") > 0) & (F.col("p") >= scanner.limit))
    longest = F.aggregate(_named("ws"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("label")), lambda a, x: F.greatest(a, x))["label"]
    known = spark.createDataFrame(_texts(), "label int, tws array<string>")
    shares = known.groupBy("label").agg(F.collect_list("tws").alias("all"))
    met = scored.withColumn("named", longest).join(F.broadcast(shares), "label", "left")  # the fixed texts
    of_text = F.coalesce(F.array_max(F.transform("all", lambda t: F.size(F.array_intersect("ws", t)) / F.size(t))), F.lit(0.0))
    met = met.withColumn("share", F.when(F.col("named") == F.col("label"), 1.0).when(F.col("named") > 0, 0.0).otherwise(of_text)).filter(F.col("share") >= CONFIRM)
    families = F.array(*[F.lit(x) for x in sorted(NAMES)])
    cell = F.struct("line", F.get(families, F.col("label") - 1).alias("family"), "p", "share")
    per = met.groupBy(F.col("did").alias(pid), F.col("th").alias(ph)).agg(F.array_sort(F.collect_set(cell)).alias(found))
    out = base.join(per, F.col(did).eqNullSafe(F.col(pid)) & F.col(th).eqNullSafe(F.col(ph)), "left")
    return out.select(*docs.columns, F.coalesce(F.col(found), F.array().cast("array<struct<line:int,family:string,p:double,share:double>>")).alias(found)), [found]


def op9_license_scans(spark, sf_dir: str) -> DataFrame:
    """Per document: licence paragraphs, their families, and where they stand."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, (found,) = scan_licenses(docs)
    x = F.col(found)
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda r: r["family"]))), ",")
    return out.select("doc_id", F.size(x).cast("long").alias("n_licenses"), families.alias("families"), F.array_join(F.transform(x, lambda r: r["line"].cast("string")), ",").alias("lines"), F.round(F.array_min(F.transform(x, lambda r: r["p"])), 4).alias("least_probability"))
