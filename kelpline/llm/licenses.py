"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs (sentences, in runs of words where they are long) with a word of
licensing, or with words that some template has in a row, are classified by
logistic regression on sparse word n-grams; a probability under a calibrated
threshold, or a family whose templates share too few word triples with the
paragraph, is unknown. So a paragraph that shares none is unknown without
being classified. All of it is DataFrame operations; the regression runs in
the JVM.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import materialise

#: A paragraph that holds one of these gets a row whatever it is found to be.
CUES = r"(?i)licen[cs]|copyright|copyleft|spdx|warrant[iy]|redistribut|permission is|all rights reserved|public domain|creative commons|\bcc[ -]by|\bcc0\b|\b[al]?gpl\b|\(c\) (19|20)[0-9]{2}|©|permission to use|hereby granted|under the terms of|subject to the terms|common development and distribution|released under|prior written|written permission|unauthori[sz]ed copying|strictly prohibited|part of this publication|source code (form|is governed)|free and unencumbered|free to copy|be liable|provided as is|as is basis|applicable law|to deal in the software|must not be misrepresented"
#: Notices by which a licence family is known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license. See LICENSE file in the project root for full license information.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "This project is available under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.", "This software is released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program.", "Released under the GPL version 2 license.", "Licensed under the GNU GPL v3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "Released under the LGPL license.",
    ),
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL license.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages, however caused and on any theory of liability, arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Available under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    "CDDL": ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0", "Licensed under the Common Development and Distribution License, version 1.0."),
    "Zlib": ("Released under the zlib License.", "SPDX-License-Identifier: Zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such under this license, and must not be misrepresented as being the original software."),
    "Artistic-2.0": ("This package is licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0", "You may redistribute it under the terms of the Artistic License 2.0."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Released under the Boost Software License."),
    "WTFPL": ("Do What The Fuck You Want To Public License, version 2.", "SPDX-License-Identifier: WTFPL", "Released under the WTFPL license."),
    "Proprietary": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved. Proprietary and confidential.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
#: Paragraphs with a cue but no licence.
OTHERS = (
    "The driver had to show a license at the border.", "Her driving licence was renewed last week.", "A fishing license costs ten euros in the village.", "The council gave the bar a licence to serve drinks until midnight.",
    "Copyright law protects authors for many years after their death.", "The court heard a copyright case about a song.", "The warranty of the machine covers two years of use.", "We give no warranty that the train will be on time.",
    "Permission is required to enter the building at night.", "He studied the history of copyright in France.", "The software licence fee rose again this year.", "Licensed plumbers must pass a test every five years.",
    "The bakery was licensed by the city in spring.", "They will redistribute the money among the members.", "The film entered the public domain after seventy years.", "Our guide explained what a license plate says about its owner.",
    "This page explains the licence of the radio station.", "Two licensed vendors sold flowers at the market.", "MIT is a university in Cambridge.", "The apache helicopter landed near the river with a license to land.",
)
PROSE = "the a of and to in is that was for on with as by at from this it were had not but one all more when there time".split()
UNKNOWN = "unknown"
#: What may stand between two tokens.
GAP = "[^a-z0-9]++"
SIZE = 1 << 13


def tokens(paragraph: Column) -> Column:
    """Lower-case words of letters, digits, dots and hyphens, final dots dropped."""
    kept = F.regexp_replace(F.lower(paragraph), r"[^a-z0-9.\-]+", " ")
    return F.filter(F.transform(F.split(F.trim(kept), " +"), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    return F.coalesce(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")), F.array().cast("array<string>"))


def triples_of(words: Column) -> Column:
    """Word triples; of fewer words, all of them together."""
    return F.when(F.size(words).between(1, 2), F.array(F.array_join(words, " "))).otherwise(grams(words, 3))


def featured(paragraphs: DataFrame) -> DataFrame:
    """Adds words and features (hashed words and word pairs) to rows with a paragraph."""
    p = paragraphs.withColumn("words", tokens(F.col("paragraph")))
    p = p.withColumn("terms", F.concat(F.col("words"), grams(F.col("words"), 2)))
    return HashingTF(numFeatures=SIZE, binary=True, inputCol="terms", outputCol="features").transform(p).drop("terms")


def examples() -> list[tuple[str, str, int]]:
    """(paragraph, family, source) of the training set: notices, parts of them, and other prose.

    A fixed set of under 3000 rows, the same on every run; ``source`` numbers
    the notice or sentence that a row is made from.
    """
    rows: list[tuple[str, str, int]] = []
    notices = [(n, f) for f, own in TEMPLATES.items() for n in own]
    for source, (notice, family) in enumerate(notices):
        words = notice.split()
        own = [notice] * 3 + [notice.upper(), f"// {notice}", f"Copyright 2021 The Authors. {notice}"]
        own += [" ".join(words[:-2]), f"{notice} It is provided as is."] * (len(words) > 6)
        for j in range(2):  # within a longer sentence
            pick = [PROSE[zlib.crc32(f"{notice} {j} {i}".encode()) % len(PROSE)] for i in range(12)]
            own.append(" ".join([*pick[:6], notice.rstrip("."), *pick[6:]]))
        rows += [(p, family, source) for p in own]
    for k, text in enumerate(OTHERS):
        words = text.split()
        own = [text] * 3 + [text.upper(), " ".join(words[: len(words) // 2 + 2])]
        for j in range(16):
            pick = [PROSE[zlib.crc32(f"{k} {j} {i}".encode()) % len(PROSE)] for i in range(12)]
            own.append(" ".join([*pick[:6], words[j % len(words)], *pick[6:]]))
        rows += [(p, UNKNOWN, len(notices) + k) for p in own]
    return rows


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Constant rows as a relation of the JVM."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows]))
    of = ", ".join(f.replace(" ", ": ", 1) for f in schema.split(", "))
    return spark.range(1).select(F.explode(F.from_json(text, f"array<struct<{of}>>")).alias("r")).select("r.*")


@dataclass
class Classifier:
    model: LogisticRegressionModel
    families: list[str]
    threshold: float
    #: Word triples of each family's notices, a list a notice.
    notices: dict[str, list[list[str]]]


def train(spark: SparkSession, most_false: float = 0.01, folds: int = 2) -> Classifier:
    """Fits on the examples; the threshold lets through ``most_false`` of unseen prose.

    For the threshold, each fold of the sources is judged by a model fitted on
    the others, so no sentence is judged by one that has seen any form of it:
    it is the least probability above which at most that share of the unknown
    class would pass as a licence.
    """
    families = [UNKNOWN, *sorted(TEMPLATES)]
    rows = [(p, float(families.index(f)), zlib.crc32(f"{source}".encode()) % folds) for p, f, source in examples()]
    data = materialise(featured(_values(spark, rows, "paragraph string, label double, fold int")).select("label", "fold", "features"))
    lr = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=80)
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(families) - 1))
    unseen: list[float] = []
    for k in range(folds):
        trial = lr.fit(data.where(F.col("fold") != k)).transform(data.where((F.col("fold") == k) & (F.col("label") == 0)))
        unseen += [float(r[0]) for r in trial.select(best).collect()]
    unseen.sort(reverse=True)
    threshold = unseen[int(most_false * len(unseen))] + 1e-6
    notices = _values(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, notice string")
    each = {r[0]: sorted(map(sorted, r[1])) for r in notices.groupBy("family").agg(F.collect_set(F.array_distinct(triples_of(tokens(F.col("notice")))))).collect()}
    return Classifier(lr.fit(data), families, min(threshold, 0.9), each)


@functools.lru_cache(maxsize=2)
def _trained(app: str) -> Classifier:
    return train(SparkSession.active())


def _branches(phrases: set[str]) -> str:
    """A regular expression for the phrases that tries each leading character once."""
    by: dict[str, set[str]] = {}
    for p in phrases:
        if p:
            by.setdefault(p[0], set()).add(p[1:])
    own = []
    for c in sorted(by):
        rest = set() if "" in by[c] else by[c]  # a phrase that has ended settles all that begin with it
        own.append((GAP if c == " " else re.escape(c)) + (_branches(rest) if rest else ""))
    return own[0] if len(own) == 1 else f"(?:{'|'.join(own)})"


def shared_words(notices: dict[str, list[list[str]]]) -> str:
    """A regular expression that lower-case text matches if it holds a word triple of any notice.

    It may match other text too, as it does not see where tokens with dots end.
    """
    return "(?<![a-z0-9])" + _branches({t for own in notices.values() for n in own for t in n})


def paragraphs(docs: DataFrame, longest: int = 48, shared: str | None = None) -> DataFrame:
    """doc_id, paragraph_index, run_index, paragraph and cue of paragraphs with a cue or words that ``shared`` matches, from whole texts.

    Paragraphs are the sentences of each line. Of a sentence of more than
    ``longest`` words they are its runs of so many words, each of which begins
    in the middle of the one before, so a notice among other words is judged
    much as it is alone.
    """
    # one pass over the text; a point between a word and a number or a small letter ends no sentence
    sentences = F.split(F.coalesce(F.col("text"), F.lit("")), r"\n|(?<=[.!?])[ \t]+(?=[^ \ta-z0-9])")
    half, words = longest // 2, F.col("words")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - half, F.lit(1)), F.lit(half))
    runs = F.when(F.size(words) > longest, F.transform(starts, lambda i: F.array_join(F.slice(words, i, longest), " "))).otherwise(F.array(F.col("whole")))
    cue = lambda c: F.col(c).rlike(CUES)
    read = lambda c: cue(c) | F.lower(c).rlike(shared) if shared else cue(c)
    held = docs.where(read("text")).select("doc_id", F.posexplode(sentences).alias("sentence", "whole")).where(read("whole"))
    held = held.withColumn("words", F.split(F.trim("whole"), r"\s+"))
    out = held.select("doc_id", "sentence", F.posexplode(runs).alias("run", "paragraph"))
    return out.where(read("paragraph")).select("doc_id", F.col("sentence").alias("paragraph_index"), F.col("run").alias("run_index"), "paragraph", cue("paragraph").alias("cue"))


def scan(docs: DataFrame, classifier: Classifier | None = None, overlap: float = 0.4, contained: float = 0.5) -> DataFrame:
    """doc_id, paragraph_index, run_index, family, probability, overlap: a row per paragraph with a cue or a licence.

    A paragraph without a cue is judged alike; it has no row if it is unknown.
    ``paragraph_index`` counts sentences, ``run_index`` the runs of a long one.
    ``family`` is ``unknown`` where the regression says so, where its
    probability lies under the calibrated threshold, or where under ``overlap``
    of the paragraph's word triples occur in the family's templates (the column
    ``overlap``) and of none of these more than ``contained`` occurs in the
    paragraph. Null and empty texts have no paragraphs; a null doc_id is kept;
    repeated rows give repeated results; an empty table gives an empty result;
    other columns are ignored. No shuffle; the templates are a constant of some
    hundred triples.
    """
    c = classifier or _trained(docs.sparkSession.sparkContext.applicationId)
    each = c.notices
    triples = {f: [t for notice in own for t in notice] for f, own in each.items()}
    out = c.model.transform(featured(paragraphs(docs, shared=shared_words(each))))
    p = vector_to_array("probability")
    family = F.element_at(F.array(*map(F.lit, c.families)), F.col("prediction").cast("int") + 1)
    out = out.select("doc_id", "paragraph_index", "run_index", "cue", family.alias("said"), F.round(F.array_max(p), 6).alias("probability"), triples_of(F.col("words")).alias("triples"), grams(F.col("words"), 2).alias("pairs"))
    known = F.create_map(*[x for f in sorted(triples) for x in (F.lit(f), F.array(*map(F.lit, sorted(set(triples[f])))))])
    same = F.size(F.array_intersect("triples", F.coalesce(F.element_at(known, F.col("said")), F.array().cast("array<string>"))))
    share = F.when(F.size("triples") > 0, same / F.size(F.array_distinct("triples"))).otherwise(F.lit(0.0))
    out = out.withColumn("overlap", F.round(share, 6))
    # notices of two words are pairs
    held = F.create_map(*[x for f in sorted(each) for x in (F.lit(f), F.array(*[F.array(*map(F.lit, sorted(set(n)))) for n in sorted(each[f])]))])
    covered = F.exists(F.element_at(held, F.col("said")), lambda n: F.size(F.array_intersect(n, F.concat("triples", "pairs"))) > contained * F.size(n))
    like = (F.col("overlap") >= overlap) | F.coalesce(covered, F.lit(False))
    sure = (F.col("said") != UNKNOWN) & (F.col("probability") >= c.threshold) & like
    out = out.select("doc_id", "paragraph_index", "run_index", F.when(sure, F.col("said")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "overlap", "cue")
    return out.where(F.col("cue") | (F.col("family") != UNKNOWN)).drop("cue")
