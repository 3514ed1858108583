from pyspark.sql import functions as F

from mooring.llm.common import hash_sample


def test_one_key_in_all_rows_gives_one_row(spark):
    df = spark.range(20_000).select(F.lit(7).alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    one = hash_sample(df, "k", 600).collect()
    assert len(one) == 1 and one == hash_sample(df.repartition(7), "k", 600).collect()


def test_bounded_and_the_same_for_any_split(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).cast("string").alias("c"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    a = sorted(r.id for r in hash_sample(df, "id", 200).collect())
    assert 150 < len(a) <= 200 and a == sorted(r.id for r in hash_sample(df.repartition(11), "id", 200).collect())
    by = hash_sample(df.union(df), "id", 50, by="c").groupBy("c").count().collect()
    assert len(by) == 3 and all(r["count"] <= 50 for r in by)


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (1, None)], "k bigint, t string")
    assert [r.k for r in hash_sample(df, "k", 5).collect()] == [1] and hash_sample(df.where("false"), "k", 5).count() == 0
