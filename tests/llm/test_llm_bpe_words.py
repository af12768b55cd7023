"""Long words, wide rows and columns with the names that the stage adds."""

import random
import time

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tabulon.llm import bpe
from tabulon.llm.queries import VOCABULARY


def test_a_long_run_of_letters_is_merged_fast():
    vocabulary, library = bpe.read_vocabulary(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    for word in ("".join(rng.choice("etaoinshr") for _ in range(200_000)), "a" * 200_000, "ab" * 50_000, "x", ""):
        start = time.time()
        got = bpe.merge_word(word.encode(), vocabulary)
        assert time.time() - start < 20
        assert got == library.encode(word, add_special_tokens=False).ids


def test_lexicon_of_the_commonest_words(spark):
    docs = spark.createDataFrame([("a b b c c c d d d d " * 3,), ("e f g",)], "text string")
    codec = bpe.build_codec(docs, VOCABULARY, lexicon_words=4)
    library = Tokenizer.from_file(VOCABULARY)
    rows = bpe.encode_documents(docs, codec).collect()
    assert [r["ids"] for r in rows] == [library.encode(r["text"], add_special_tokens=False).ids for r in rows]
    none = bpe.build_codec(docs.limit(0), VOCABULARY)
    assert bpe.encode_documents(docs, none).count() == 2


def test_bpe_stage_with_clashing_columns_and_wide_structs(spark):
    wide = F.struct(*[F.lit(i).alias(f"f{i}") for i in range(40)])
    docs = spark.createDataFrame([(1, "some text here"), (2, None)], "doc_id long, text string")
    docs = docs.withColumns({"ids": F.lit("old"), "n_tokens": F.lit(-1), "decoded": F.lit(7), "wide": wide})
    rows = {r["doc_id"]: r for r in pipeline.bpe_stage(spark, docs, "").collect()}
    library = Tokenizer.from_file(VOCABULARY)
    assert rows[1]["ids"] == library.encode("some text here", add_special_tokens=False).ids and rows[1]["n_tokens"] == len(rows[1]["ids"])
    assert rows[1]["text"] == "some text here" and rows[1]["decoded"] == 7 and rows[1]["wide"]["f39"] == 39
    assert rows[2]["ids"] == [] and rows[2]["text"] == ""
