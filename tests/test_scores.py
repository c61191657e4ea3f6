"""All pairs of many queries are made by all cores, however few files the rows come from."""

import numpy as np
from pyspark.sql import functions as F

from vecsieve.operators import search


def test_one_file_is_dealt_over_all_cores(spark):
    value = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(17)).cast("double") - 8
    rows = spark.range(0, 500, 1, 1).select("id", F.array(*map(value, range(4))).alias("vec"))
    got = search.scores(rows.filter("id < 200"), rows.filter("id >= 200"))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 200 * 300 / 4
    x = np.array([r["vec"] for r in rows.orderBy("id").collect()])
    assert {(r["query_id"], r["image_id"]): r["sim"] for r in got.collect()} == {(q, d): float(x[q] @ x[d]) for q in range(200) for d in range(200, 500)}


def test_rounded_as_spark_rounds(spark):
    x = np.concatenate([np.random.default_rng(2).uniform(-2, 2, 20000), np.arange(-3000, 3000) / 2e5, np.arange(-999, 999) / 2e6 + 1, [np.nan, np.inf, -np.inf, -0.0, -1e-9, 1e17 + 16, 12345678.123455, 1e300, 5e-324]])
    for digits in (5, 6):
        want = np.array([r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", digits)).collect()])
        got = search.rounded(x, digits)
        assert ((got == want) | (np.isnan(got) & np.isnan(want))).all() and not np.signbit(got[got == 0]).any()


def test_result_rows_are_not_rounded_one_by_one(spark):
    from vecsieve.plans import catalog, catalog_more  # noqa: F401

    for name in ("pca_angles", "vlad_rank", "bow_rank"):
        tree = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "round(" not in tree.splitlines()[0] and "MapInArrow" in tree.splitlines()[0]
