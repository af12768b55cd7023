"""BPE, classifiers, licences, quotes and mixing."""

import random
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import bpe, license_rules, mixing, quotation, toxicity
from tabulon.llm.language import fit_language, predict_language
from tabulon.llm.quality import features, fit_quality, margin, score_quality
from tabulon.llm.queries import VOCABULARY
from tabulon.llm.transducer import compile_words, ranks

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, source string"


def odd_texts():
    rng = random.Random(2)
    letters = "ab's td rve'l \n\t 12é日<|endoftext|>   ,.!\x1c"
    out = [None, "", " ", "it's we'll I'VE 'tis don't''s 's ''s x'd' 'round a\n\n b  c   \n", "<|endoftext|>a<|endoftext|><|endoftext|> b", "a" * 5000, "<|endof", "text|>"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_bpe_round_trip_equals_the_library(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 0.5, None) for i, t in enumerate(texts)], DOCS)
    codec = bpe.build_codec(docs, VOCABULARY, lexicon_words=50)
    library = Tokenizer.from_file(VOCABULARY)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    coded = bpe.decode_documents(bpe.encode_documents(docs, codec), codec)
    rows = sorted(coded.collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in rows] == want
    assert [r.decoded for r in rows] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert rows[3].score == 0.5
    digests = bpe.round_trip_digests(docs, codec).collect()
    assert {r.doc_id: r.n_tokens for r in digests} == {i: len(w) for i, w in enumerate(want)}


def test_bpe_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert bpe.round_trip_digests(docs, bpe.build_codec(docs, VOCABULARY)).collect() == []


def test_transducer_ranks_its_words_and_no_others():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    tables = compile_words(words)
    asked = words + [b"", b"z", b"abcabcabc", b"aaaaaab"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    got = ranks(tables, data, ends - [len(w) for w in asked], ends)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in asked]
    assert len(tables["final"]) < sum(map(len, words)) / 2  # suffixes are shared


def brute_margin(index, value, w, v, bias):
    pairs = sum(v[i] @ v[j] * value[a] * value[b] for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
    return bias + value @ w[index] + pairs


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=30), rng.normal(size=(30, 8))
    index, value = np.array([1, 4, 9, 20]), rng.normal(size=4)
    assert margin(index, value, w, v, 0.3)[0] == pytest.approx(brute_margin(index, value, w, v, 0.3))


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, 1.0, None) for i, (t, _) in enumerate(rows)] + [(9001, None, None, None), (9002, "", None, None)], DOCS)
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(9003, 1), (0, None)], "doc_id long, target int")


def test_toxicity_learns_words_and_keeps_odd_rows(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = [rng.choice(["sun", "tree", "walk", "house", "blue", "river"]) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["Vile", "vilely", "rotten"])
        rows.append((" ".join(words), int(i % 4 == 0)))
    docs, labels = labelled(spark, rows)
    model = toxicity.fit_toxicity(docs, labels)
    scores = {r.doc_id: r.toxic_score for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(scores) == 302 and scores[9001] == scores[9002] < 0.5
    assert np.mean([(scores[i] > 0.3) == y for i, (_, y) in enumerate(rows)]) > 0.97
    assert len(model.places) < 2000  # sparse
    nothing = toxicity.fit_toxicity(docs, labels.where("doc_id < 0"))
    assert {r.toxic_score for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


def test_quality_learns_structure(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = [rng.choice(["sun", "tree", "walk", "house", "blue", "river"]) + str(rng.randrange(30)) for _ in range(50)]
        rows.append((" ".join(words) if i % 3 else " | ".join(words).upper(), int(i % 3 > 0)))
    docs, labels = labelled(spark, rows)
    docs = docs.withColumn("n_chars", F.length("text"))
    model = fit_quality(docs, labels)
    scores = {r.doc_id: r.quality_score for r in score_quality(docs, model).collect()}
    assert len(scores) == 302 and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= 0.5) == y for i, (_, y) in enumerate(rows)]) > 0.97


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    one = [tuple(map(tuple, f)) for f in features(pa.array(["a b", "b b a"]), pa.array([3, 5]))]
    two = [tuple(map(tuple, next(features(pa.array([t]), pa.array([n]))))) for t, n in (("a b", 3), ("b b a", 5))]
    assert one == two


def test_language_of_small_texts(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate(
        [("the quick brown fox and the lazy dog", "en"), ("der schnelle braune fuchs und der faule hund", "de"), ("ça va être là où déjà", "fr")] * 20
    )]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", "de"), (902, "the dog", None)], "doc_id long, text string, lang string")
    model = fit_language(docs)
    got = {r.doc_id: r.language for r in predict_language(docs, model).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert got[900] == got[901] == ("und", 0.0) and got[902].lang_pred == "en"
    assert 0 < model.temperature
    empty = fit_language(docs.limit(0))
    assert {r.language.lang_pred for r in predict_language(docs, empty).collect()} == {"und"}


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'


@pytest.mark.parametrize("text,want", [
    (None, ""), ("", ""), ("MIT", ""), ("Some words\nReleased under the MIT License.", "MIT"), (MIT, "MIT"),
    ("SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"), ("MIT. SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("SPDX-License-Identifier: " + "x y. " * 9 + "MIT.", ""),
    ("LICENSED under   CC BY-NC 4.0. And: this work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0,GPL-3.0"),
    ("I like the MIT License.", ""),
])
def test_license_rules(spark, text, want):
    docs = spark.createDataFrame([(1, text, None, None)], DOCS)
    assert [r.licenses for r in license_rules.scan_licenses(docs).collect()] == [want]


def test_longer_bsd_rule_replaces_the_shorter(spark):
    parts = [license_rules.SENTENCES[n][0] for n in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    docs = spark.createDataFrame([(1, "\n".join(parts[:3]), None, None), (2, "\n".join(parts), None, None)], DOCS)
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in license_rules.scan_licenses(docs).collect()}
    assert got == {1: ("BSD-2-Clause", 3), 2: ("BSD-3-Clause", 4)}


def test_quotes_link_replies(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?"),
        (1, 1, "user", "And how do I reverse it afterwards?"),
        (1, 2, "assistant", "A wrote:\n> How do I  SORT a list?\n\nUse sorted on it please."),
        (1, 3, "user", ">> How do I sort a list?\n> Use sorted on it please.\nThanks, that works fine."),
        (1, 4, None, "> never said by anyone here\nodd"),
        (2, 0, "user", "> How do I sort a list?\nother conversation"),
        (None, 1, "user", "> x"), (3, None, "user", None), (3, 5, "user", ""), (3, 5, "user", ""),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", F.lit(1))
    got = quotation.link_quotations(table).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].parent_turn, by[1, t].root_turn, by[1, t].depth) for t in range(5)] == [(None, 0, 0), (None, 1, 0), (0, 0, 1), (2, 0, 2), (None, 4, 0)]
    assert by[1, 2].content == "Use sorted on it please." and by[1, 3].n_quotes == 2
    assert by[2, 0].parent_turn is None and by[3, None].content == ""
    assert by[1, 4].formatted == "<|unknown|>\nodd"
    assert quotation.link_quotations(table.limit(0)).collect() == []


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    words = ["sun", "tree", "walk", "house", "blue", "river"]
    rows = []
    for i in range(400):
        text = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(text) if i % 4 else " | ".join(text).upper(), None, None))
    docs = spark.createDataFrame(rows + [(900, None, None, None), (901, "", None, None)], DOCS)
    labels = spark.createDataFrame([(i, "high" if i % 4 else "low") for i in range(0, 400, 3)] + [(5, None), (6, "else")], "doc_id long, domain string")
    got = mixing.mixing_rates(docs, labels, {"high": 0.5, "low": 0.5}).collect()
    totals = {k: sum(r.tokens * r[f"p_{k}"] * r.rate for r in got) for k in ("high", "low")}
    whole = sum(r.tokens for r in got)
    assert len(got) == 402 and all(r.rate >= 0 for r in got)
    assert totals["high"] == pytest.approx(whole / 2, rel=1e-3) and totals["low"] == pytest.approx(whole / 2, rel=1e-3)
    model, _ = mixing.fit_mixing(docs, labels, {"high": 1.0, "low": 0.5}, repeat=False, relative=True)
    mixed = mixing.mix(docs, model)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == mixed.count() > 300
    assert mixing.mix(docs.limit(0), model).collect() == []
    assert mixing.mixing_rates(docs.limit(0), labels, {"high": 0.5, "low": 0.5}).collect() == []
    even = mixing.mixing_rates(docs, labels.limit(0), {"high": 0.5, "low": 0.5}).collect()
    assert {round(r.p_low, 6) for r in even} == {0.5}


def test_mixing_without_repeats_of_soft_members(spark):
    rng = random.Random(8)
    words = ["sun", "tree", "walk", "house", "blue", "river"]
    rows = []
    for i in range(600):
        text = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(40)]
        rows.append((i, " ".join(text) if i % 2 else " | ".join(text).upper(), None, None))
    docs = spark.createDataFrame(rows, DOCS)
    # One label in five contradicts the kind of text, so no document is of one domain alone.
    labels = spark.createDataFrame([(i, "high" if (i % 2) ^ (i % 5 == 0) else "low") for i in range(600)], "doc_id long, domain string")
    model, members = mixing.fit_mixing(docs, labels, {"high": 1.0, "low": 0.5}, repeat=False, relative=True)
    got = members.withColumn("rate", model.rate()).collect()
    assert all(0 <= r.rate <= 1 for r in got)
    kept, whole = ([sum(r["__tokens"] * r[f"__p{k}"] * (r.rate if part else 1) for r in got) for k in range(2)] for part in (1, 0))
    assert (kept[1] / kept[0]) / (whole[1] / whole[0]) == pytest.approx(0.5, rel=1e-2)
    mixed = [r.doc_id for r in mixing.mix(docs, model).collect()]
    assert len(set(mixed)) == len(mixed) > 300


GPL = "This program is free software{a} you can redistribute it and/or modify\n# it under the terms of the GNU {name} as published by\n# the Free Software Foundation{b} either version {v} of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU {name} for more details."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GPL.format(a=":", b=",", v=3, name="General Public License"), "GPL-3.0"),
        (GPL.format(a=";", b=";", v=2, name="General Public License"), "GPL-2.0"),
        (GPL.format(a=":", b=",", v=3, name="Affero General Public License"), "AGPL-3.0"),
        (GPL.format(a=":", b=",", v=3, name="Lesser General Public License"), "LGPL-3.0"),
        (GPL.format(a=";", b=";", v="2.1", name="Lesser General Public License").replace("program", "library"), "LGPL-2.1"),
        (MPL, "MPL-2.0"),
        ("// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;", "LGPL-2.1"),
        ("Free software is a fine thing. This library is free software.", ""),
    ],
)
def test_license_headers(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.licenses for r in license_rules.scan_licenses(docs).collect()] == [want]


def test_known_sentences_hold_no_end_mark():
    """The scan cuts at end marks, so a sentence with one inside could never be found."""
    for sentences in license_rules.SENTENCES.values():
        assert not any(re.search(r"[.!?;:]+\s", s) for s in sentences)
    assert {n for _, names in license_rules.RULES for n in names} <= set(license_rules.SENTENCES)


def test_a_quoted_sentence_links_however_it_is_wrapped(spark):
    long = "The index grows with the data. Merging it takes\nan hour on the old machines! We should look into that."
    rows = [
        (1, 0, "user", long),
        (1, 1, "assistant", "Some words that nobody quotes at all."),
        (1, 2, "user", "> Merging it takes an hour on the old\n> machines!\nWhich ones?"),
        (1, 3, "assistant", "> We should look into that.\nYes."),
        (1, 4, "user", "> We should.\nNo link: too short, and nobody said it."),
        (1, 5, "user", "> Merging it takes an hour. We should look into that.\nHalf of it was said."),
        (2, 0, "user", "> We should look into that.\nAnother conversation."),
    ]
    got = quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == {
        (1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): None, (1, 5): 0, (2, 0): None
    }


@pytest.mark.parametrize("text", ["", "One two. Three four five! six", 'He said "go now, please." Then he left. Ok.', "a b c\nd e f.\n\ng h i"])
def test_sentences_of_passages(text):
    found = dict(quotation.passages(text.split("\n")))
    for paragraph in text.split("\n\n"):
        for sentence in re.split(r"(?<=[.!?])\s+|(?<=[.!?][\"])\s+", " ".join(paragraph.split())):
            words = sentence.lower().split()
            if len(words) >= quotation.LEAST_LINE_WORDS:
                assert found[quotation._hash(words)] == len(words)


def test_mixing_steps_equal_a_plain_fit_and_a_miss_is_reported(spark, monkeypatch):
    rng = random.Random(5)
    words = ["sun", "tree", "walk", "house", "blue", "river"]
    texts = [" ".join(rng.choice(words) + rng.choice("abcd") for _ in range(rng.randint(5, 90))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t if i % 3 else t.upper(), None, None) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, "b" if (i % 3 == 0) ^ (i % 7 == 0) else "a") for i in range(300)], "doc_id long, domain string")
    weights = {"a": 0.3, "b": 0.7}
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        model, members = mixing.fit_mixing(docs, labels, weights)
    assert model.miss < mixing.TOLERANCE
    rows = members.withColumn("rate", model.rate()).collect()
    p = np.array([[r["__p0"], r["__p1"]] for r in rows])
    tokens, rate = np.array([r["__tokens"] for r in rows], float), np.ones(len(rows))
    natural = tokens @ p
    targets = natural.sum() * np.array([0.3, 0.7])
    while True:
        miss = ((tokens * rate) @ p - targets) / natural
        if np.abs(miss).max() < mixing.TOLERANCE:
            break
        rate = np.maximum(rate - p @ miss, 0)
    assert np.allclose([r.rate for r in rows], rate, rtol=1e-9, atol=1e-9)
    monkeypatch.setattr(mixing, "STEPS", 2)
    with pytest.warns(UserWarning, match="misses its target"):
        short, _ = mixing.fit_mixing(docs, labels, weights)
    assert short.miss >= mixing.TOLERANCE and len(short.steps) == 2
