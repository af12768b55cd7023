"""The filter audit against removal by removal."""

import re
from itertools import permutations

from tabulon.llm import filter_audit as fa
from tabulon.llm import queries

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, _ in rows),
        })
    return out


def expected(rows, labels):
    fails, out = failures(rows), {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(fails[i][f] for i in mine) - len(gone),
                    sum(fails[i][f] and sum(fails[i].values()) == 1 for i in mine),
                    sum(labels.get(rows[i][0], (0, 0))[0] == 1 for i in gone), sum(labels.get(rows[i][0], (0, 0))[1] == 1 for i in gone), f,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in df.collect()}


def test_audit_equals_removals(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, long, "en"), (2, long, "en"), (3, long, "de"), (3, long, "de"), (4, None, None), (5, "", "en"), (None, long, "en"), (None, "", None),
        (6, "LOUD " * 150, "en"), (7, long + " #tag", "en"), (8, long + " x", "de"), (9, "word " * 30_000, "de"), (2, long, "en"),
        (10, long + "  ", None), (11, long.upper(), "en"), (12, "a|b", ""),
    ]
    labels = {1: (1, 0), 2: (1, 1), 5: (0, 1), 6: (None, 1), 7: (1, None), 9: (1, 0)}
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], DOCS + ", part int, n int")
    marks = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(1, 0, 0), (None, 1, 1), (99, 1, 1)], LABELS)
    assert result(fa.audit_filters(fa.flag_documents(docs), marks)) == expected(rows, labels)


def test_potentials_give_shapley_of_a_symmetric_game(spark):
    rows = [(0, "#", "en")]  # fails A and D only: both share it
    table = fa.coalition_table(fa.flag_documents(spark.createDataFrame(rows, DOCS)), spark.createDataFrame([], LABELS)).first()
    assert table["worth"][0b01001] == 1 and table["worth"][0b00001] == 1 and table["worth"][0b00010] == 0
    assert table["potential"][31] - table["potential"][31 - 1] == 30  # one half, 60-fold
    assert table["potential"][31] - table["potential"][31 - 8] == 30


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert fa.audit_filters(fa.flag_documents(none), spark.createDataFrame([], LABELS)).collect() == []


def test_audit_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert result(queries.op12_filter_audit(spark, folder)) == expected(rows, labels)
