"""Scale mechanisms: hot-key salting, partition independence, spread,
hot groups in aggregates and windows."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ratewise.operators import joins, reports
from ratewise.operators.partitioning import spread
from ratewise.operators.rate import rate_scores, rate_table
from ratewise.plans import jobs
from ratewise.sources import tables


@contextmanager
def _conf(spark, values):
    saved = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_salted_join_equals_plain_join(spark):
    big = spark.range(0, 20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                        .otherwise((F.col("id") % 50).cast("string")).alias("k"))
    look = spark.range(0, 50).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("v"))
    look = look.unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    look = look.join(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    salted = joins.salted_lookup_join(big, look, "k", "n", F.col("id"), target=1000)
    plain = big.join(look, "k")
    assert sorted(salted.select("id", "v").collect()) == sorted(plain.select("id", "v").collect())
    # with a shuffled, uncoalesced join the hot key's rows land on several reducers
    with _conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1",
                       "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                       "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        parts = (salted.filter(F.col("k") == "hot").withColumn("p", F.spark_partition_id())
                 .select("p").distinct().count())
    assert parts > 1


def test_buckets_follow_the_row_count(spark):
    df = spark.createDataFrame([(1,), (1000,), (1001,), (10 ** 9,)], "n long")
    assert [r.b for r in df.select(joins.buckets_of(F.col("n"), 1000).alias("b")).collect()] == [1, 1, 2, 10 ** 6]


def _jobs(spark, build):
    """Spark jobs started while ``build`` runs."""
    sc = spark.sparkContext
    group = f"group-{id(build)}"
    sc.setJobGroup(group, "building")
    try:
        build()
    finally:
        sc.setJobGroup("none", "")
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_building_a_plan_runs_nothing(spark):
    docs = spark.range(100).select((F.col("id") % 7).alias("k"), F.lit("some text").alias("text")).groupBy("k").agg(F.first("text").alias("text"))
    assert _jobs(spark, lambda: jobs.score_and_rate(docs, "text")) == 0
    assert _jobs(spark, lambda: reports.compliance_rollup(jobs.score_and_rate(docs.withColumnRenamed("k", "lang"), "text"))) == 0


def test_row_index_after_a_shuffle_keeps_every_row(spark):
    n = 300_000
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), F.lit(0.5).alias("violence_score"), F.lit(0.1).alias("sexual_score"),
                               F.lit(0.1).alias("language_score"), F.lit(0.1).alias("substance_score"), F.repeat(F.lit("x"), 128).alias("text"))
    with _conf(spark, {"spark.sql.shuffle.partitions": "8"}):
        out = rate_table(df.repartition("k")).agg(F.count("song_index").alias("n"), F.count_distinct("song_index").alias("d"),
                                                  F.min("song_index").alias("a"), F.max("song_index").alias("b")).first()
    assert tuple(out) == (n, n, 0, n - 1)


def test_text_dedup_moves_the_text_once_and_never_sorts_it(spark):
    docs = tables.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    keyed = docs.select(F.monotonically_increasing_id().alias("__row"), F.unhex(F.sha2("text", 256)).alias("key"), F.col("text").alias("cleaned"))
    distinct = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("__row").alias("__row"))
    assert "SortAggregate" not in distinct._jdf.queryExecution().executedPlan().toString()
    with _conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = keyed.select("__row", "cleaned").join(distinct.hint("shuffle_hash"), "__row")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort [" not in plan


def test_labels_join_below_the_cleaning(spark):
    from ratewise.plans import catalog
    plan = catalog.QUERIES["label_check"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Join Inner")  # the join is the deeper node


def test_result_independent_of_partitioning(spark):
    f7 = tables.order_scores(spark, SF_SMALL)
    a = rate_table(f7.coalesce(1)).collect()
    b = rate_table(f7.repartition(7, "song_index")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    docs = tables.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    x = jobs.score_and_rate(docs.coalesce(1), "text").select("doc_id", "mcr_rating", "severity").collect()
    y = jobs.score_and_rate(docs.repartition(5), "text").select("doc_id", "mcr_rating", "severity").collect()
    assert sorted(map(tuple, x)) == sorted(map(tuple, y))


def test_spread_only_when_asked(spark):
    df = spark.range(0, 1000, numPartitions=1)
    assert spread(df) is df
    assert spread(df, 4).rdd.getNumPartitions() == 4
    with _conf(spark, {"ratewise.text.partitions": "6"}):
        assert spread(df).rdd.getNumPartitions() == 6


def test_hot_group_in_histogram_and_topk(spark):
    # one rating holds most rows: partial aggregation and the partial window
    # group limit keep the per-task work bounded; results stay exact
    n = 30_000
    scores = spark.range(0, n).select(
        F.col("id").alias("song_index"),
        F.when(F.col("id") % 10 < 7, F.lit(0.0)).otherwise((F.col("id") % 97) / 96.0).alias("violence_score"),
        F.lit(0.0).alias("sexual_score"), F.lit(0.0).alias("language_score"), F.lit(0.0).alias("substance_score"))
    rated = rate_scores(scores)
    hist = {r.rating: r.n for r in reports.rating_histogram(rated).collect()}
    assert sum(hist.values()) == n and hist["M-E"] >= 0.7 * n
    top = reports.top_k_by_group(rated.select("song_index", "MCR_rating", "MCR_max_score"), 3,
                                 "MCR_rating", "MCR_max_score", "song_index")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = top.collect()
    assert all(r["rank"] <= 3 for r in got) and len(got) == 3 * len(hist)


def test_descriptor_counts_filter_stays_above_generate(spark):
    rated = rate_scores(tables.order_scores(spark, SF_SMALL))
    plan = reports.descriptor_counts(rated)._jdf.queryExecution().optimizedPlan().toString()
    # the 'None' filter sits on the exploded column, not inlined into the scan side
    assert plan.index("Filter") < plan.index("Generate")


def test_spread_even_with_one_hot_id(spark):
    df = spark.range(0, 9000, numPartitions=1).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"))
    sizes = [r.n for r in spread(df, 6).groupBy(F.spark_partition_id())
             .agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes)


def test_rating_screen_pushes_to_parquet(spark):
    import tempfile
    from ratewise.functions import rating as R
    path = tempfile.mkdtemp(prefix="rw-push-") + "/scores"
    tables.order_scores(spark, SF_SMALL).write.parquet(path)
    cols = ["violence_score", "sexual_score", "language_score", "substance_score"]
    stored = spark.read.parquet(path)
    screened = stored.filter(R.rating_filter("M-T", *cols)).select("song_index")
    with _conf(spark, {"spark.sql.maxMetadataStringLength": "10000"}):
        plan = screened._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(violence_score,0.7)" in plan
    # and only the needed columns are read
    assert "ReadSchema: struct<song_index:bigint,violence_score:double" in plan
    exact = rate_scores(stored).filter(F.col("MCR_rating").isin("M-E", "M-P", "M-T"))
    assert screened.count() == exact.count()


def test_rating_is_map_only_and_codegen(spark):
    out = rate_table(tables.order_scores(spark, SF_SMALL))
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    projects = [ln for ln in plan.splitlines() if "Project [" in ln]
    assert projects and all("*(" in ln for ln in projects), plan[:2000]
    scored = jobs.with_classification(
        tables.embedding_probabilities(spark, SF_SMALL)
        .withColumns(__import__("ratewise.functions.severity", fromlist=["x"]).category_percentages("probs"))
        .withColumn("raw_probabilities", F.col("probs")))
    plan2 = scored._jdf.queryExecution().executedPlan().toString()
    assert all("*(" in ln for ln in plan2.splitlines() if "Project [" in ln), plan2[:2000]
