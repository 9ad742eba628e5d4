"""One key holding most rows: same results, no oversized group, stable under partitioning."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochwise.operators import allocation, compare, joins, ranks
from epochwise.plans import registry


def skewed(spark, n=6000):
    """Two thirds of all rows belong to key 0."""
    return spark.range(n).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).cast("int").alias("k"), F.col("id").alias("v"))


def test_block_row_number_equals_the_window(spark):
    df = skewed(spark)
    got = ranks.block_row_number(df, ["k"], ["v"], F.floor(F.col("v") / 100), "rn", total="n")
    want = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("v")).cast("bigint")).withColumn("n", F.count("v").over(W.partitionBy("k")))
    assert compare.symmetric_difference(got.select("k", "v", "rn", "n"), want).count() == 0


def fixed_ranges(spark, on):
    """Small inputs keep their ranges apart, so their sizes can be looked at."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not on).lower())


def test_range_row_number_of_text_in_one_group(spark):
    """One stratum, text keys with a common prefix: equal to the window, and no range holds most of the rows."""
    df = spark.range(8000).select(F.lit("all").alias("g"), F.concat(F.lit("SUBJECT-P"), F.lpad((F.col("id") * 7919 % 100_003).cast("string"), 9, "0")).alias("s")).repartition(6)
    fixed_ranges(spark, True)
    try:
        by = df.repartitionByRange(8, "g", "s").groupBy(F.spark_partition_id()).count()
        assert by.count() == 8 and by.agg(F.max("count")).first()[0] < 2000
        got = ranks.range_row_number(df, ["g"], ["s"], "rn", total="n", parts=8)
        want = df.withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy("s")).cast("bigint")).withColumn("n", F.count("s").over(W.partitionBy("g")))
        assert compare.symmetric_difference(got.select("g", "s", "rn", "n"), want).count() == 0
    finally:
        fixed_ranges(spark, False)


def test_allocation_of_text_and_sparse_ids(spark):
    """The same rows in the same order of ids get the same blocks, whatever the ids look like."""
    weights = {"ctl": 1.0, "act": 2.0}
    base = spark.range(500).select(F.col("id").alias("n"))
    kinds = {"text": F.concat(F.lit("P"), F.lpad("n", 6, "0")), "sparse": F.col("n") * F.col("n") * 10**9, "dense": F.col("n")}
    for name, key in kinds.items():
        rows = allocation.permuted_blocks(base.select("n", key.alias("subject"), F.lit("x").alias("sex")), weights, ["sex"], 6, "7").collect()
        assert {(r.n, r.block_index) for r in rows} == {(n, n // 6) for n in range(500)}, name
        audit = {}
        for r in rows:
            audit.setdefault(r.block_index, []).append(r.allocated_arm)
        assert all(sorted(a) == ["act"] * 4 + ["ctl"] * 2 for b, a in audit.items() if b < 83), name


def test_buckets_of_cohorts_with_a_common_prefix(spark):
    rows = spark.range(300).select(F.concat(F.lit("COHORT-"), F.lpad((F.col("id") % 100).cast("string"), 5, "0")).alias("cohort"), "id")
    got = {r.cohort: r.bucket for r in ranks.bucket_key(rows, "cohort", 7).collect()}
    assert got == {f"COHORT-{k:05d}": f"P{k // 7:05d}" for k in range(100)}


def test_hot_split_join_equals_the_join(spark):
    left = skewed(spark)
    right = spark.range(45).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("right", "full_outer"):
        with pytest.raises(ValueError):
            joins.hot_split_join(left, right, "k", how)
    for how in ("left", "inner"):
        a, b = joins.hot_split_join(left, right, "k", how), left.join(right, "k", how)
        assert compare.symmetric_difference(a.select("k", "v", "w"), b.select("k", "v", "w")).count() == 0


@pytest.mark.parametrize("name", ["agg03_safety_table", "win08_permuted_blocks", "sta08_bootstrap"])
def test_results_do_not_depend_on_shuffle_partitions(spark, name):
    sf = "/root/testdata/sf0.001"
    frames = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        frames.append(sorted(map(str, registry.QUERIES[name](spark, sf).collect())))
    assert frames[0] == frames[1]


def _write_tables(spark, d, hot):
    """The driver tables with one customer and one user holding two thirds of the rows."""
    src = "/root/testdata/sf0.001"
    o, e = spark.read.parquet(f"{src}/orders.parquet"), spark.read.parquet(f"{src}/events.parquet")
    o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 < 2, hot).otherwise(F.col("o_custkey"))).write.parquet(f"{d}/orders.parquet")
    e.withColumn("user_id", F.when(F.col("event_id") % 3 < 2, hot).otherwise(F.col("user_id"))).write.parquet(f"{d}/events.parquet")
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hot"))
    _write_tables(spark, d, 7)
    return d


@pytest.mark.parametrize("name", ["win02_change_from_baseline", "win05_cumulative_exposure", "joi05_report_merge", "agg01_arm_summary"])
def test_hot_keys_keep_results_right(spark, hot_dir, name):
    import duckdb

    from tools.check import TABLES, compare as same

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{hot_dir}/{t}.parquet/*.parquet')")
    assert same(registry.QUERIES[name](spark, hot_dir).toPandas(), con.execute(registry.ORACLES[name]).df()) == ""


def test_hot_subject_owns_few_rows_per_epoch(spark, hot_dir):
    from epochwise.plans import views

    most = views.obs_events(spark, hot_dir).groupBy("subject").count().agg(F.max("count")).first()[0]
    assert most <= 31
