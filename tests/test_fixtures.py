"""Hand-computed fixtures of the reference's contracts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsieve.functions import text as T
from vecsieve.functions import vectors as V
from vecsieve.operators import encode as E
from vecsieve.operators import fit, metrics, mining, pool, search
from vecsieve.plans import config, runner
from vecsieve.sources import runlog, tables
from vecsieve.streaming import latest as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def vectors(spark, rows):
    return frame(spark, [(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>")


def test_ranking_is_a_permutation(spark):
    out = search.rank(vectors(spark, [[1, 0], [0, 1]]), vectors(spark, [[1, 0], [0, 1], [0.7071, 0.7071]])).orderBy("query_id", "rank").collect()
    assert [r["image_id"] for r in out] == [0, 2, 1, 1, 2, 0]


def test_protocols_and_metrics(spark):
    db = vectors(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 1]])
    queries = vectors(spark, [[0.1, 0.2, 0.9], [0.9, 0.2, 0.1]])
    truth = metrics.explode_truth(frame(spark, [(0, [2], [0], []), (1, [0], [2], [])], "query_id long, easy array<long>, hard array<long>, junk array<long>"))
    ids = queries.select(F.col("id").alias("query_id"))
    per = metrics.query_metrics(search.rank(queries, db), truth, ids)
    got = {r["protocol"]: r["map"] for r in metrics.evaluate(per).collect()}
    assert got["easy"] == 1.0 and got["hard"] == pytest.approx(0.25) and got["medium"] == pytest.approx(0.791667, abs=1e-6)
    none = truth.filter("grade = 'easy'")
    hard = {r["protocol"]: r for r in metrics.evaluate(metrics.query_metrics(search.rank(queries, db), none, ids)).collect()}["hard"]
    assert hard["num_queries"] == 0 and hard["num_excluded"] == 2 and math.isnan(hard["map"])


def ranking(spark, items):
    return frame(spark, [(0, d, float(-i), i) for i, d in enumerate(items)], "query_id long, image_id long, sim double, rank long")


@pytest.mark.parametrize("order,positives,ignored,ap", [([1, 3, 0, 2, 4], [1, 3], [], 1.0), ([0, 2, 4, 1, 3], [1, 3], [], 0.225), ([0, 1, 2, 3, 4], [1, 3], [0], 0.791667)])
def test_average_precision(spark, order, positives, ignored, ap):
    truth = frame(spark, [(0, d, "easy") for d in positives] + [(0, d, "junk") for d in ignored], "query_id long, image_id long, grade string")
    per = metrics.query_metrics(ranking(spark, order), truth, spark.range(1).select(F.col("id").alias("query_id")))
    assert per.filter("protocol = 'easy'").first()["ap"] == pytest.approx(ap, abs=1e-6)


def test_precision_is_capped_by_the_last_positive(spark):
    truth = frame(spark, [(0, 1, "easy"), (0, 3, "easy")], "query_id long, image_id long, grade string")
    ids = spark.range(1).select(F.col("id").alias("query_id"))
    assert metrics.query_metrics(ranking(spark, [0, 2, 4, 1, 3]), truth, ids, 10).filter("protocol = 'easy'").first()["precision"] == pytest.approx(0.4)


def test_vector_functions(spark):
    row = frame(spark, [([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    got = row.select(V.hellinger(F.col("a")).alias("h"), V.safe_l2_normalize(F.col("z")).alias("z"), V.crop_box(F.array(F.lit(0.5), F.lit(1.5))).alias("b")).first()
    assert got["h"] == pytest.approx([math.sqrt(3 / 7), math.sqrt(4 / 7)]) and got["z"] == [0, 0] and got["b"] == [0, 2]


CENTERS = np.array([[0.0, 0], [10, 0], [0, 10]])


def local(spark, rows):
    return frame(spark, [(i, k, [float(x) for x in v]) for i, vs in rows.items() for k, v in enumerate(vs)], "image_id long, kp int, vec array<double>")


def test_assignment_ties_go_to_the_lowest(spark):
    out = search.nearest(local(spark, {0: [(1, 1), (9, 1), (1, 9), (5, 0)]}), CENTERS).orderBy("kp").collect()
    assert [r["word"] for r in out] == [0, 1, 2, 0]


def test_idf_and_tfidf(spark):
    tf = frame(spark, [(0, 0, 1), (1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 2, 1), (3, 2, 1)], "image_id long, word int, tf long")
    words = spark.range(4).select(F.col("id").cast("int").alias("word"))
    idf = E.inverse_document_frequency(tf, spark.range(4), words)
    assert {r["word"]: r["idf"] for r in idf.collect()} == pytest.approx({0: math.log(4 / 3), 1: math.log(4), 2: math.log(2), 3: 0})
    w = {r["word"]: r["w"] for r in E.tfidf(tf, idf).filter("image_id = 1").collect()}
    assert w[0] ** 2 + w[1] ** 2 == pytest.approx(1)


def test_vlad(spark):
    raw = E.vlad_raw(local(spark, {0: [(1, 1), (2, 0), (9, 0)]}), CENTERS[:2])
    read = lambda df: [r["value"] for r in df.orderBy("word", "dim").collect()]
    assert read(raw) == [3, 1, -1, 0]
    assert read(E.vlad_encode(raw, None, True)) == pytest.approx([0.948683 / 2**0.5, 0.316228 / 2**0.5, -1 / 2**0.5, 0], abs=1e-5)
    assert read(E.vlad_encode(raw, None, False)) == pytest.approx([x / 11**0.5 for x in (3, 1, -1, 0)])


def test_fisher(spark):
    m = E.Mixture(np.ones(1), np.zeros((1, 1)), np.ones((1, 1)))
    raw = {r["part"]: r["value"] for r in E.fisher_raw(local(spark, {0: [(2,)]}), m).collect()}
    assert raw == pytest.approx({0: 2, 1: 3 / 2**0.5})
    gamma = E.posteriors(local(spark, {0: [(2,)]}), m).first()["gamma"]
    assert gamma == 1


def test_fits(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.1 * rng.standard_normal((50, 2)) for c in CENTERS])
    blobs = local(spark, {0: x.tolist()})
    assert np.allclose(fit.lloyd(blobs, CENTERS + 1), [x[i : i + 50].mean(0) for i in (0, 50, 100)])
    assert len(fit.train_vocabulary(blobs, 3)) == 3
    got = fit.train_mixture(blobs, E.Mixture(np.full(3, 1 / 3), CENTERS + 1, np.ones((3, 2))), 5)
    assert np.allclose(sorted(got.weights), 1 / 3, atol=1e-3)
    low = rng.standard_normal((200, 5)) @ rng.standard_normal((5, 32))
    out = fit.pca_fit(vectors(spark, low), 8).transform(vectors(spark, low)).collect()
    assert all(len(r["vec"]) == 8 and np.linalg.norm(r["vec"]) == pytest.approx(1) for r in out)
    with pytest.raises(ValueError):
        fit.pca_fit(vectors(spark, low), 33)


def test_supervised_whitening_whitens_pairs(spark):
    rng = np.random.default_rng(1)
    base = np.repeat(rng.standard_normal((400, 6)), 2, 0)
    x = base + rng.standard_normal((800, 6)) * np.array([1.5, *[0.05] * 5])
    pairs = frame(spark, [(2 * i, 2 * i + 1) for i in range(400)], "q long, p long")
    model = fit.supervised_whitening(vectors(spark, x), pairs)
    d = x[::2] - x[1::2]
    assert np.allclose(model.components @ (d.T @ d / 400) @ model.components.T, np.eye(6), atol=1e-8)


def test_regions():
    assert pool.regions(16, 16, 1) == [(0, 0, 16, 16)]
    assert len(pool.regions(16, 24, 1)) == 2


def test_mining_and_losses(spark):
    rows = [(0, 0, i, c, float(s)) for i, (c, s) in enumerate(zip([0, 0, 0, 1, 2, 3], [9, 8, 7, 3, 2, 1]))]
    out = mining.mine_negatives(frame(spark, rows, "query_id long, query_cluster int, image_id long, cluster int, sim double"), 3)
    assert [r["image_id"] for r in out.orderBy("rank").collect()] == [3, 4, 5]
    t = frame(spark, [(0, [1.0, 0.0], [0.0, 1.0], [[1.0, 0.0], [-1.0, 0.0]])], "query_id long, q array<double>, p array<double>, negatives array<array<double>>")
    assert mining.contrastive_loss(t, 0.85).first()["loss"] == pytest.approx(0.5 * (2 + 0.85**2))
    assert mining.early_stop([0.1, 0.2, 0.2005, 0.201, 0.2012], 2, 0.001)[0] == 4
    assert {r["id"]: r["dense"] for r in mining.dense_remap(frame(spark, [(9,), (2,), (5,), (2,)], "id long")).collect()} == {2: 0, 5: 1, 9: 2}


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    for k, m, at in ((64, 0.3, 1), (128, 0.4, 2), (64, 0.5, 3)):
        value = {"map": m, "mp_at_k": m, "k": 10, "num_queries": 70, "num_excluded": 0}
        runlog.append(spark, runlog.RunRecord("roxford5k", "rparis6k", "vlad", {"k": k, "seed": 0}, {"hard": value, "easy": value}, None, None, f"2026-01-0{at}T00:00:00+00:00"), path)
    records = runlog.load(spark, path)
    assert records.count() == 3
    got = {r["params"]: r["metrics"]["hard"]["map"] for r in runlog.current(records).collect()}
    assert sorted(got.values()) == [0.4, 0.5]
    assert {r["dim"] for r in runlog.tidy(records).collect()} == {8192, 16384}
    assert [r["hard"] for r in runlog.show(records, current_only=True).collect()] == ["0.5000", "0.4000"]
    assert runlog.show(records, technique="bow").count() == 0
    spark.createDataFrame([('{"dataset": "x", "other": 1}',)], "value string").write.mode("append").text(path)
    with pytest.raises(Exception, match="unknown fields"):
        runlog.load(spark, path).collect()
    assert runlog.load(spark, path, strict=False).count() == 4


def test_store_makes_once(spark, tmp_path):
    store, calls = tables.Store(spark, str(tmp_path)), []
    make = lambda: (calls.append(1), spark.range(3))[1]
    assert store.get("kmeans", make, k=3, seed=0).count() == 3 == store.get("kmeans", make, k=3, seed=0).count()
    assert len(calls) == 1 and store.index("kmeans").first()["sample"] == 0
    tables.write_state(spark, str(tmp_path / "s"), {"b": 1, "a": [2]})
    assert tables.read_state(spark, str(tmp_path / "s")) == {"a": [2], "b": 1}
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    out = tables.key_differences(keys("a", "b.num_batches_tracked"), keys("a", "c"), (".num_batches_tracked",)).collect()
    assert [(r["key"], r["problem"]) for r in out] == [("c", "unexpected")]


def test_configurations():
    assert [r.descriptor.k for r in config.sweep(config.Run(config.Bow()), (1000, 20000))] == [1000, 20000]
    with pytest.raises(ValueError):
        config.HeldOutSplit("roxford5k", "roxford5k")
    with pytest.raises(ValueError):
        config.Pooled(p="learned")
    with pytest.raises(ValueError):
        config.sweep(config.Run(config.Vit()), (1,))
    assert config.from_options("vlad", {"k": "8", "power": "0.5"}).power == 0.5 and len(config.PRESETS) == 9


def test_runner_end_to_end(spark):
    rng = np.random.default_rng(2)
    parts = lambda n, at: local(spark, {i: rng.standard_normal((3, 4)).tolist() for i in range(at, at + n)})
    truth = frame(spark, [(0, 100, "easy"), (1, 101, "hard")], "query_id long, image_id long, grade string")
    inputs = runner.Inputs(parts(20, 500), parts(6, 100), parts(2, 0), spark.range(100, 106), spark.range(2), truth)
    for d in (config.Bow(k=4), config.Vlad(k=3), config.Fisher(k=2)):
        record = runner.run_one(spark, config.Run(d), inputs)
        assert set(record.metrics) == {"easy", "medium", "hard"} and record.metrics["easy"]["num_queries"] == 1


def test_stream_and_text(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, seq long, v string").write.parquet(path)
    out = stream.run_to_end(stream.latest_by_key(stream.stream(spark, path, "k long, seq long, v string"), ["k"], "seq"), "latest_test")
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, "b"), (2, "c")]
    assert stream.Heartbeat(900).stalled() is False
    row = spark.createDataFrame([(1.0, 0.05, 1234.5)], "a double, b double, c double")
    assert list(row.select(*[T.format_number(F.col(c)) for c in "abc"]).first()) == ["1", "0.05", "1234.5"]
