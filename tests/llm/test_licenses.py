import re

import pytest

from kelpline.llm import licenses
from kelpline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.train(spark)


def families(documents, texts, classifier):
    out = licenses.scan(documents([(k, t, "s") for k, t in enumerate(texts)]), classifier)
    return {(r["doc_id"], r["paragraph_index"]): r["family"] for r in out.collect()}


def test_notices(documents, classifier):
    texts = [
        "Some words.\nReleased under the MIT License.\nMore words.", "Licensed under the Apache License, Version 2.0.", "x\n\nThis work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "All rights reserved.", "// SPDX-License-Identifier: MPL-2.0", "LICENSED UNDER THE GNU LESSER GENERAL PUBLIC LICENSE, VERSION 2.1.",
    ]
    want = {(0, 1): "MIT", (1, 0): "Apache-2.0", (2, 2): "GPL", (3, 0): "CC-BY-NC", (4, 0): "Proprietary", (5, 0): "MPL-2.0", (6, 0): "LGPL"}
    assert families(documents, texts, classifier) == want


def test_unknown(documents, classifier):
    texts = ["My dog needs a license from the town hall before summer.", "The copyright lawsuit was settled out of court in March.", "They promised to redistribute the harvest among three villages."]
    assert set(families(documents, texts, classifier).values()) == {"unknown"}


def test_a_sentence_in_a_long_line(documents, classifier):
    line = "Plain words follow one another here. " * 40 + "Released under the MIT License. " + "And then some more of them came. " * 40
    got = families(documents, [line], classifier)
    assert list(got.values()) == ["MIT"]


def test_odd_rows_and_empty(documents, odd_rows, classifier):
    assert licenses.scan(documents(odd_rows), classifier).count() == 0
    assert licenses.scan(documents([]), classifier).count() == 0
    both = documents([(1, "Released under the MIT License.", "s")] * 2 + [(None, "Released under the MIT License.", None)])
    assert [r["family"] for r in licenses.scan(both, classifier).collect()] == ["MIT"] * 3


def test_a_notice_within_a_longer_sentence(documents, classifier):
    texts = [
        "The source code of this small library was released under the MIT License in March by its two authors.",
        "Text on this site is available under the Creative Commons Attribution 4.0 International License unless otherwise noted.",
        "Copyright 2019 The Foo Authors and contributors. This project is licensed under the Apache License, Version 2.0 and can be used freely.",
    ]
    assert families(documents, texts, classifier) == {(0, 0): "MIT", (1, 0): "CC-BY", (2, 0): "unknown", (2, 1): "Apache-2.0"}


def test_every_template_and_variant_has_a_cue(spark):
    own = [p for p, f, _ in licenses.examples() if f != licenses.UNKNOWN]
    own += [n for ts in licenses.TEMPLATES.values() for n in ts]
    missed = spark.createDataFrame([(p,) for p in own], "p string").where(~licenses.F.col("p").rlike(licenses.CUES)).collect()
    assert not missed


def test_lines_without_the_usual_words(documents, classifier):
    texts = [
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ]
    assert families(documents, texts, classifier) == {(0, 0): "ISC", (0, 1): "ISC", (1, 0): "Proprietary", (2, 0): "Proprietary"}


def test_notices_without_a_cue(documents, classifier):
    """Lines of wrapped licence texts that hold none of the cues."""
    texts = [
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE", "direct, indirect, incidental, special, exemplary, or consequential damages, however caused and on any theory",
        "They signed the contract in the morning. Then all of them went home, for any purpose or none.",
    ]
    assert not [t for t in texts if re.search(licenses.CUES, t)]
    assert families(documents, texts, classifier) == {(0, 0): "MIT", (1, 0): "BSD"}


def test_what_shares_no_words_with_a_notice_is_unknown(spark, documents, sf_dir, classifier):
    """Whole paragraphs, without the filter, give the licences that the scan gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filtered = {tuple(r)[:4] for r in licenses.scan(docs, classifier).where("family <> 'unknown'").collect()}
    monkey = pytest.MonkeyPatch()
    monkey.setattr(licenses, "shared_words", lambda each: "(?s).*")
    every = {tuple(r)[:4] for r in licenses.scan(docs, classifier).where("family <> 'unknown'").collect()}
    monkey.undo()
    assert filtered == every and every


@pytest.mark.parametrize("words", [0, 5, 30, 40, 46, 47, 48, 60, 100, 400, 5000])
def test_a_notice_is_found_among_any_number_of_words(documents, classifier, words):
    notice = licenses.TEMPLATES["MIT"][3].rstrip(".")
    text = " ".join(["then they walked along the river"] * (words // 6)) + f" {notice} " + " ".join(["and came back to the house"] * (words // 6))
    assert "MIT" in families(documents, [text], classifier).values()


def test_a_line_is_judged_alike_whatever_its_length(documents, classifier):
    """The same notice and filler at 399, 400, 401 and many characters."""
    seen = set()
    for n in (300, 399, 400, 401, 402, 3000):
        line = "Released under the MIT License."
        line += " " + ("Plain words follow one another here. " * 200)[: n - len(line) - 1]
        out = licenses.scan(documents([(1, line, "s")]), classifier).collect()
        seen.add(tuple((r["family"], r["probability"], r["overlap"]) for r in out))
    assert len(seen) == 1 and [f for f, _, _ in seen.pop()] == ["MIT"]


def test_the_threshold_is_calibrated_on_unseen_sentences(classifier):
    sources = {}
    for p, f, source in licenses.examples():
        sources.setdefault(p.lower(), set()).add(source)
    # no sentence of the unknown class is in two sources, so none is in two folds
    assert all(len(own) == 1 for p, own in sources.items() if p in {t.lower() for t in licenses.OTHERS})
    assert 0.01 < classifier.threshold < 0.9


def plain_tokens(p):
    own = (re.sub(r"^[.\-]+|[.\-]+$", "", w) for w in re.sub(r"[^a-z0-9.\-]+", " ", p.lower()).strip().split(" "))
    return [w for w in own if w]


def test_the_query_equals_plain_python(spark, sf_dir, classifier):
    from pyspark.ml.feature import HashingTF

    import numpy as np

    at = HashingTF(numFeatures=licenses.SIZE, binary=True).indexOf
    weights, bias = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
    triples = lambda w: {" ".join(w)} if 1 <= len(w) <= 2 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if not re.search(licenses.CUES, r["text"] or ""):
            continue
        for k, sentence in enumerate(re.split(r"\n|(?<=[.!?])[ \t]+(?=[^ \ta-z0-9])", r["text"])):
            words = re.split(r"[ \t\n\x0b\f\r]+", sentence.strip(" "))
            runs = [" ".join(words[i : i + 48]) for i in range(0, max(len(words) - 24, 1), 24)] if len(words) > 48 else [sentence]
            for j, p in enumerate(runs):
                if not (re.search(licenses.CUES, sentence) and re.search(licenses.CUES, p)):
                    continue
                w = plain_tokens(p)
                pairs = {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
                z = bias + sum((weights[:, i] for i in {at(t) for t in [*w, *pairs]}), np.zeros(len(bias)))
                q = np.exp(z - z.max())
                q /= q.sum()
                said = classifier.families[int(q.argmax())]
                own = [set(n) for n in classifier.notices.get(said, [])]
                share = len(triples(w) & set().union(*own)) / len(triples(w)) if w else 0.0
                like = round(share, 6) >= 0.4 or any(len(n & (triples(w) | pairs)) > 0.5 * len(n) for n in own)
                family = said if said != "unknown" and q.max() >= classifier.threshold and like else "unknown"
                want.append((r["doc_id"], k, j, family, round(float(q.max()), 4), round(share, 4)))
    got = [(r["doc_id"], r["paragraph_index"], r["run_index"], r["family"], round(r["probability"], 4), round(r["overlap"], 4)) for r in licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), classifier).collect()]
    assert sorted(got) == sorted(want) and len(want) > 3
    again = [(r["doc_id"], r["paragraph_index"], r["run_index"], r["family"]) for r in QUERIES["op9_license_scans"](spark, sf_dir).collect()]
    assert sorted(again) == sorted(x[:4] for x in want)


@pytest.mark.parametrize("long", [" ", "-", "a", "licence ", "copyright. ", "\n"])
def test_a_megabyte_of_one_thing(documents, classifier, long):
    text = long * (1_000_000 // len(long)) + "\nReleased under the MIT License."
    assert "MIT" in families(documents, [text], classifier).values()
