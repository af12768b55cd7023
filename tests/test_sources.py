import pytest
from pyspark.sql import functions as F

from tabulon.functions import values as vx
from tabulon.plans.analyses import dataset_overview
from tabulon.sources import tables


def test_suffixes():
    assert tables.get_file_extension("/x/Data.CSV") == ".csv"
    assert tables.validate_file_type("a.parquet") == ".parquet"
    assert tables.get_dataset_name("/data/sales.2024.csv") == "sales.2024"
    with pytest.raises(ValueError, match=r"\.csv, \.parquet"):
        tables.validate_file_type("a.json")


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'a,b,c,d,e,f\n1,2.5,True,x,2024-01-01,NA\nNA,3,False,"two\nlines, quoted ""q""",2024-01-02,\n 3,n/a,true,NULL,,NaN\n'
    )
    df = tables.read_table(spark, str(path), multiline=True)
    assert dict(df.dtypes) == {
        "a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "double"
    }
    rows = df.collect()
    assert [r["a"] for r in rows] == [1, None, 3] and [r["b"] for r in rows] == [2.5, 3.0, None]
    assert rows[1]["d"] == 'two\nlines, quoted "q"' and rows[2]["d"] is None
    assert dict(tables.read_table(spark, str(path), datetimes=True, multiline=True).dtypes)["e"] == "timestamp"


def test_csv_with_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), schema="a int, b string", multiline=False)
    assert df.collect() == [(1, "x")]


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        tables.read_table(spark, str(tmp_path / "e.csv"))
    with pytest.raises(RuntimeError):
        tables.read_table(spark, str(tmp_path / "nope.parquet"))


def test_parquet_and_names(spark, tmp_path):
    path = str(tmp_path / "nums.parquet")
    spark.range(3).coalesce(1).write.parquet(path)
    df = tables.read_table(spark, path)
    assert df.count() == 3
    assert tables.with_dataset_name(df).where(F.col("dataset_name").startswith("part-")).count() == 3
    assert [r["id"] for r in tables.preview(df, 2, "id").collect()] == [0, 1]


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>score</t></is></c><c r="C1" t="s"><v>1</v></c></row>
<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c></row>
<row r="3"><c r="B3"><v>4</v></c><c r="C3" t="b"><v>0</v></c></row></sheetData></worksheet>"""
def test_long_integers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("a,b,c\n1234567890123456789,1234567890123456789012,1.5\n1234567890123456788,7,1234567890123456789\n")
    t = tables.read_table(spark, str(path))
    assert dict(t.dtypes) == {"a": "bigint", "b": "string", "c": "string"}
    assert t.select("a").distinct().count() == 2


def test_pairwise_deletion_and_selection(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (float("nan"), 2.0, 0), (1.0, None, 0)], "a double, b double, c int")
    assert vx.drop_missing_pair(df, "a", "b").count() == 1
    with pytest.raises(ValueError, match="does not exist"):
        vx.select_columns(df, ["a", "z"])


def test_overview(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(5)], "a int, b string")
    o = dataset_overview(df, "a")
    assert o.profile.row_count == 5 and o.preview.count() == 3
    assert o.missing_values.first()["column_name"] == "b"


def test_registered_queries_have_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
