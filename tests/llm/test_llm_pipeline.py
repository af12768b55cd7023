"""The pipeline's stages against a brute-force version of each on its own input."""

import re
import zlib

import corpus_pipeline as pipeline
import pytest
from tokenizers import Tokenizer

from tabulon.llm.queries import VOCABULARY
from tests_llm_helpers import closed, shingles

SMALL = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, steps = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        steps[name] = (before, after)
        assert len(after) == docs.count() and set(after) <= set(before)
        assert docs.columns[: len(columns)] == columns
    before, after = steps["exact_dedup"]
    best = {}
    for i, r in before.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = max(best.get(key, (-1, 0)), (len(r.text or ""), -i))
    assert set(after) == {-i for _, i in best.values()}
    before, after = steps["ngram_jaccard_join"]
    sets = {i: shingles(r.text, 5) for i, r in before.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(list(sets), linked)
    assert set(after) == {i for i in sets if want[i] == i}
    before, after = steps["bpe"]
    library = Tokenizer.from_file(VOCABULARY)
    assert all(r.text == before[i].text and r.ids == library.encode(r.text, add_special_tokens=False).ids for i, r in after.items())
    before, after = steps["toxicity"]
    assert len(after) > 0.8 * len(before)


@pytest.mark.parametrize("labelled", ["none", "held out", "elsewhere"])
def test_toxicity_stage_without_labels_keeps_documents(spark, tmp_path, labelled):
    docs = spark.createDataFrame([(i, f"clean text number {i}") for i in range(20)], "doc_id long, text string")
    ids = {"none": [], "held out": range(20), "elsewhere": range(1000, 1400)}[labelled]
    rows = [(i, i % 2) for i in ids if labelled != "held out" or zlib.crc32(str(i).encode()) % 4 == 2]
    assert rows or labelled == "none"
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.warns(UserWarning, match="nothing learned"):
        kept = pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert sorted(kept.collect()) == sorted(docs.collect())


def test_near_dedup_stage_with_repeated_ids(spark, tmp_path):
    def text(name, end=""):
        return " ".join(f"{name}{i}" for i in range(80)) + end

    rows = [
        (2, text("a")), (5, text("a", " x")), (5, text("b")),  # only one text of id 5 is a copy
        (7, text("c")), (7, text("c", " y")),  # near copies under one id
        (8, text("d")), (8, text("d")), (1, text("b", " z")), (9, text("e")),
        (6, None), (6, ""), (None, text("e", " w")),
    ]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))
    sevens = [r for r in got if r[0] == 7]
    assert len(sevens) == 1 and sevens[0] in rows
    assert sorted((r for r in got if r[0] not in (6, 7)), key=str) == sorted(
        [(2, text("a")), (8, text("d")), (1, text("b", " z")), (9, text("e")), (None, text("e", " w"))], key=str
    )
    assert [i for i, _ in got].count(6) == 1

    rows = [(2, text("a")), (5, text("a", " x")), (5, text("b"))]
    got = pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, text("a")), (5, text("b"))]
