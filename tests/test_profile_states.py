import math

import pytest
from pyspark.sql import functions as F

from tabulon.operators import profile_states as ps


def table(spark, low, high):
    rows = spark.range(low, high, 1, 3)
    return rows.select(
        F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("n"), F.col("id") % 50)).alias("name"),
        F.lit("a note of more than six words in all").alias("note"),
        F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("id") * 0.5 + 1e6).alias("price"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("day"),
        (F.col("id") % 2 == 0).alias("flag"), (F.col("id") / 4).cast("decimal(10,2)").alias("amount"),
        F.array(F.lit("x"), F.col("id").cast("string")).alias("tags"),
    )


def check(df, rows):
    total = df.count()
    for r in rows.values():
        c = r["column_name"]
        values = [v for (v,) in df.select(c).collect() if v is not None and v == v]
        assert (r["row_count"], r["missing_count"]) == (total, total - len(values))
        distinct = len({str(v) for v in values})
        assert abs(r["unique_estimate"] - distinct) <= 4 * r["unique_error"] * distinct + 1
        if r["column_type"] == "numeric":
            x = sorted(map(float, values))
            mean = math.fsum(x) / len(x)
            assert (r["minimum"], r["maximum"]) == (x[0], x[-1])
            assert r["mean"] == pytest.approx(mean, rel=1e-12)
            sd = math.sqrt(math.fsum((v - mean) ** 2 for v in x) / (len(x) - 1))
            assert r["standard_deviation"] == pytest.approx(sd, rel=1e-9)
            for q, v in zip((0.25, 0.5, 0.75), r["quantiles"]):
                assert abs(sum(a <= v for a in x) / len(x) - q) <= 2 * r["rank_error"]


def test_only_new_and_changed_files_are_read(spark, tmp_path):
    data, states = f"{tmp_path}/data", f"{tmp_path}/states"
    table(spark, 0, 3000).write.parquet(data)
    assert ps.update_states(spark, data, states) == 3
    assert ps.update_states(spark, data, states) == 0
    rows = {r["column_name"]: r for r in ps.incremental_profile(spark, data, states).collect()}
    check(spark.read.parquet(data), rows)
    assert list(rows) == [c.split()[0] for c in "k,name,note,price,day,flag,amount,tags".split(",")]
    assert [r["column_type"] for r in rows.values()] == ["numeric", "categorical", "text", "numeric", "datetime", "boolean", "numeric", "other"]
    assert rows["note"]["average_words"] == 9.0 and rows["note"]["max_words"] == 9
    # More files: only they are read, and the figures are those of the whole table.
    table(spark, 3000, 5000).coalesce(2).write.mode("append").parquet(data)
    assert ps.update_states(spark, data, states) == 2
    check(spark.read.parquet(data), {r["column_name"]: r for r in ps.incremental_profile(spark, data, states).collect()})
    # A table written anew: old files' states no longer count.
    table(spark, 10, 500).coalesce(1).write.mode("overwrite").parquet(data)
    assert ps.update_states(spark, data, states) == 1
    check(spark.read.parquet(data), {r["column_name"]: r for r in ps.incremental_profile(spark, data, states).collect()})


def test_states_written_twice_count_once(spark, tmp_path):
    data, states = f"{tmp_path}/data", f"{tmp_path}/states"
    table(spark, 0, 100).write.parquet(data)
    ps.update_states(spark, data, states)
    twice = spark.createDataFrame(spark.read.parquet(states).collect(), ps.STATE_SCHEMA)
    twice.write.mode("append").parquet(states)
    check(spark.read.parquet(data), {r["column_name"]: r for r in ps.incremental_profile(spark, data, states).collect()})


def test_one_file_partition_folders_and_empty_tables(spark, tmp_path):
    one = f"{tmp_path}/one"
    table(spark, 0, 50).coalesce(1).write.parquet(one)
    (name,) = [r["file"] for r in ps.table_files(spark, one).collect()]
    assert ps.update_states(spark, name, f"{tmp_path}/s1") == 1
    assert ps.incremental_profile(spark, name, f"{tmp_path}/s1").first()["row_count"] == 50
    parts = f"{tmp_path}/parts"
    table(spark, 0, 60).withColumn("part", F.col("k") % 2).coalesce(1).write.partitionBy("part").parquet(parts)
    rows = {r["column_name"]: r for r in ps.incremental_profile(spark, parts, f"{tmp_path}/s2").collect()}
    assert (rows["part"]["minimum"], rows["part"]["maximum"], rows["part"]["row_count"]) == (0.0, 1.0, 60)
    none = f"{tmp_path}/none"
    table(spark, 0, 0).coalesce(1).write.parquet(none)
    rows = ps.incremental_profile(spark, none, f"{tmp_path}/s3").collect()
    assert {(r["row_count"], r["missing_count"], r["mean"], r["quantiles"]) for r in rows} <= {(0, 0, None, None)}


def test_columns_without_a_value(spark, tmp_path):
    path = f"{tmp_path}/nulls"
    spark.createDataFrame([(None, None, None)] * 3, "a int, b string, c double").coalesce(1).write.parquet(path)
    for r in ps.incremental_profile(spark, path, f"{tmp_path}/s").collect():
        assert (r["row_count"], r["missing_count"], r["unique_estimate"]) == (3, 3, 0)
        assert r["mean"] is None and r["minimum"] is None and r["standard_deviation"] is None
