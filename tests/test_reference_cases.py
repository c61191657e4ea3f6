"""Cases of configurations, the run log, caches, tracking, training and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsieve.functions import text as T
from vecsieve.operators import fit, pool, search
from vecsieve.plans import cli, config, runner, training
from vecsieve.sources import corpus, runlog, tables, tracking


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_numbers_and_parameters_as_text(spark):
    told = [5e-7, 1e-12, 1e6, 1234567.0, 0.05, 1.0, 2837705.0, 1.000005, -12345.25, 0.0, float("nan")]
    got = rows(spark, [(x,) for x in told], "x double").select(T.format_number("x").alias("t")).collect()
    assert [r["t"] for r in got] == ["%g" % x for x in told]
    params = json.dumps({"scales": [1.0, 2**-0.5, 0.5], "whiten": True, "dim": None, "lr": 5e-7, "k": 64, "name": "a"})
    shown = rows(spark, [(params,)], "p string").select(T.shown_params(F.col("p")).alias("m")).first()["m"]
    assert shown == {"scales": "1|0.707107|0.5", "whiten": "True", "dim": "None", "lr": "5e-07", "k": "64", "name": "a"}


@pytest.mark.parametrize("wrong", [
    {"p": "learned"}, {"weights": "sfm120k"}, {"checkpoint": "x"}, {"whiten_source": "learned", "whiten": True},
    {"weights": "sfm120k", "p": "learned", "whiten_source": "learned"}, {"weights": "sfm120k", "p": "learned", "whiten_source": "learned", "whiten": True, "shrinkage": 0.1}, {"shrinkage": -1.0},
])
def test_experiments_that_do_not_exist(wrong):
    with pytest.raises(ValueError):
        config.Pooled(**wrong)


def test_configurations_and_presets():
    assert config.Pooled().backbone == "alexnet" and config.Pooled(whiten=True).dim is None
    assert config.Vit().model == "dinov2-vitl14" and config.Vit(whiten=True).readout == "native"
    for bad in ({"whiten_source": "learned"}, {"readout": "cls"}):
        with pytest.raises(ValueError):
            config.Vit(**bad)
    with pytest.raises(ValueError):
        config.Rmac(weights="sfm120k")
    tuned = config.PRESETS["gem-ft-vgg16"]
    assert (tuned.p, tuned.weights, tuned.last_pool, tuned.whiten, tuned.whiten_source) == ("learned", "sfm120k", False, True, "learned")
    assert config.PRESETS["gem-r101"].backbone == "resnet101" and config.PRESETS["gem-r101"].dim == 2048
    widths = [config.descriptor_dim(d) for d in (config.Bow(k=64), config.Vlad(k=64), config.Fisher(k=64), config.NeuralCodes(dim=None), config.Pooled(), config.Pooled(dim=32), config.Vit(), config.Vit("dinov2-vits14"))]
    assert widths == [64, 8192, 16384, 4096, 256, 32, 1024, 384]


def record(k, m, **more):
    value = {"map": m, "mp_at_k": m, "k": 10, "num_queries": 70, "num_excluded": 0}
    return runlog.RunRecord("roxford5k", "rparis6k", "vlad", {"k": k, "seed": 0} | more, {"hard": value, "easy": value}, 1.5, "abc", "2026-01-01T00:00:00+00:00")


def test_log_order_keys_and_tracking(spark, tmp_path):
    path = str(tmp_path / "runs")
    for k, m in ((64, 0.3), (128, 0.4), (64, 0.5), (64.0, 0.6), ("64", 0.7)):
        runlog.append(spark, record(k, m), path)
    got = runlog.current(runlog.load(spark, path)).collect()
    assert sorted(r["metrics"]["hard"]["map"] for r in got) == [0.4, 0.5, 0.6, 0.7], "1, 1.0 and text are three values"
    turned = rows(spark, [('{"b": [1, 2], "a": "x, y"}',), ('{"a":"x, y","b":[1, 2]}',)], "p string").select(runlog.canonical(F.col("p")).alias("p"))
    assert {r["p"] for r in turned.collect()} == {'{"a": "x, y", "b": [1, 2]}'}
    first = runlog.first_seen(runlog.load(spark, path), [F.col("technique"), runlog.canonical(F.col("params"))]).orderBy("place").collect()
    assert [r["metrics"]["hard"]["map"] for r in first] == [0.5, 0.4, 0.6, 0.7]
    store = str(tmp_path / "store")
    assert tracking.replay(runlog.load(spark, path), store) == 5 and tracking.replay(runlog.load(spark, path), None) == 0
    seen = {r["run"]: r for r in spark.read.parquet(store).collect()}
    assert set(seen) == {"vlad-roxford5k-k64-seed0", "vlad-roxford5k-k128-seed0"}
    assert seen["vlad-roxford5k-k128-seed0"]["metrics"]["easy/map"] == 0.4 and seen["vlad-roxford5k-k128-seed0"]["config"]["k"] == "128"


def test_results_tell_an_empty_store_from_an_empty_filter(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    path = str(tmp_path / "log")
    assert cli.main(["results", path]) == 0 and "no runs recorded yet" in capsys.readouterr().out
    runlog.append(spark, record(64, 0.25), path)
    assert cli.main(["results", path, "--technique", "bow"]) == 0 and "(1 recorded)" in capsys.readouterr().out
    assert cli.main(["results", path]) == 0 and "0.2500" in capsys.readouterr().out
    assert cli.main(["track", path, str(tmp_path / "t")]) == 0 and "1 runs" in capsys.readouterr().out
    assert cli.main(["train"]) == 2 and cli.main(["presets"]) == 0


def test_widths_of_transformers(spark):
    made = rows(spark, [("vit", m) for m in runlog.VIT_WIDTHS] + [("vit", "other"), ("gem", None)], "t string, m string")
    got = made.select("m", runlog.descriptor_dim(F.col("t"), F.create_map(F.lit("model"), F.col("m"))).alias("d")).collect()
    assert {r["m"]: r["d"] for r in got} == runlog.VIT_WIDTHS | {"other": None, None: None}


def test_null_vectors_take_no_part(spark):
    schema = "id long, vec array<double>"
    db = rows(spark, [(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0]), (3, [None, 1.0])], schema)
    for small in (1 << 20, 0):
        got = search.scores(db, db, small=small, block=2, query_block=1).collect()
        assert sorted((r["query_id"], r["image_id"], r["sim"]) for r in got) == [(0, 0, 1.0), (0, 2, 0.0), (2, 0, 0.0), (2, 2, 1.0)]
    assert {r["id"]: r["word"] for r in search.nearest(db, np.eye(2)).collect()} == {0: 0, 2: 1}
    assert fit.gram(db).first()["n"] == 2


def test_grids_by_hand():
    assert pool.regions(4, 4, 2) == [(0, 0, 4, 4), (0, 0, 2, 2), (0, 2, 2, 2), (2, 0, 2, 2), (2, 2, 2, 2)]
    assert pool.regions(2, 8, 1) == [(0, x, 2, 2) for x in (0, 1, 2, 4, 5, 6)]
    assert pool.regions(8, 2, 1) == [(y, 0, 2, 2) for y in (0, 1, 2, 4, 5, 6)]
    assert pool.regions(1, 1, 3) == [(0, 0, 1, 1)]


def test_fitted_models_are_kept(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    local = lambda n, at: rows(spark, [(i, k, rng.standard_normal(4).tolist()) for i in range(at, at + n) for k in range(3)], "image_id long, kp int, vec array<double>")
    truth = rows(spark, [(0, 100, "easy"), (1, 101, "hard")], "query_id long, image_id long, grade string")
    inputs = runner.Inputs(local(20, 500), local(6, 100), local(2, 0), spark.range(100, 106), spark.range(2), truth)
    store, calls = tables.Store(spark, str(tmp_path)), []
    real = fit.train_vocabulary
    monkeypatch.setattr(fit, "train_vocabulary", lambda *a: (calls.append(1), real(*a))[1])
    for d in (config.Bow(k=4), config.Vlad(k=4), config.Bow(k=4), config.Fisher(k=2), config.Fisher(k=2)):
        runner.run_one(spark, config.Run(d), inputs, store=store)
    assert len(calls) == 2, "bag of words and VLAD share a vocabulary; the mixture is another"


def test_learned_whitening_is_attached_and_chosen(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = {k: rows(spark, [(i, rng.standard_normal(3).tolist()) for i in range(40)], "id long, vec array<double>") for k in ("ss", "ms")}
    learned = runner.learn_whitening(vectors, rows(spark, [(i, i + 1) for i in range(0, 40, 2)], "q long, p long"))
    runner.attach(spark, str(tmp_path / "w"), learned)
    back = runner.attached(spark, str(tmp_path / "w"))
    inputs = runner.Inputs(vectors["ss"], vectors["ss"], vectors["ss"], vectors["ss"], vectors["ss"], vectors["ss"], back)
    tuned = lambda **k: config.Run(config.Pooled(weights="sfm120k", p="learned", whiten=True, whiten_source="learned", **k))
    assert np.allclose(runner.projection(tuned(), inputs).components, learned["ss"].components)
    assert np.allclose(runner.projection(tuned(scales=(1.0, 0.5), dim=2), inputs).components, learned["ms"].components[:2])
    with pytest.raises(ValueError):
        runner.projection(tuned(dim=4), inputs)


def test_resumed_training_equals_fresh(spark, tmp_path):
    rng = np.random.default_rng(2)
    vecs = rows(spark, [(i, rng.standard_normal(4).tolist()) for i in range(60)], "id long, vec array<double>")
    held = corpus.Corpus(rows(spark, [(i, str(i), i // 4) for i in range(60)], "id long, cid string, cluster long"), rows(spark, [(i, i, i + 1) for i in range(0, 60, 4)], "pair_id long, q long, p long"))
    setup = lambda n: config.Train(epochs=n, pairs=5, pool=30, negatives=2, patience=2)
    scored = [0.1, 0.3, 0.3, 0.3, 0.9]

    def go(n, path, seen):
        return training.train(spark, held, lambda ids: ids.join(vecs, "id"), lambda t, e: seen.append((e, sorted(map(tuple, t.collect())))), lambda e: scored[e], setup(n), path, lambda s: None)

    fresh, parts = [], []
    whole = go(5, None, fresh)
    go(2, str(tmp_path), parts)
    assert go(5, str(tmp_path), parts) == whole and parts == fresh
    assert whole["epoch"] == 4 and whole["best"] == 0.3 and whole["best_epoch"] == 1


def test_corpus_and_manifest(spark):
    sides = [rows(spark, [(i, i) for i in x], "k long, v long") for x in ((1, 2), (1, 3))]
    with pytest.raises(Exception, match="do not match"):
        corpus.zip_strict(sides[0], sides[1].withColumnRenamed("v", "w"), "k").collect()
    manifest = rows(spark, [(0, "bbaabb"), (1, "aabbcc")], "place long, cid string")
    files = rows(spark, [("r/bb/aa/bb/bbaabb",), ("r/cc/bb/aa/aabbcc",)], "path string")
    assert [r["path"] for r in corpus.manifest_paths(manifest, files, "r").collect()] == ["r/bb/aa/bb/bbaabb", "r/cc/bb/aa/aabbcc"]
    with pytest.raises(Exception, match="no file"):
        corpus.manifest_paths(manifest, files.limit(1), "r").collect()


def test_mini_batches_find_the_blobs(spark):
    centers = np.array([[0.0, 0], [10, 0], [0, 10]])
    rng = np.random.default_rng(0)
    points = rows(spark, [(i, (centers[i % 3] + 0.1 * rng.standard_normal(2)).tolist()) for i in range(150)], "id long, vec array<double>")
    assert np.abs(fit.mini_batches(points, centers + 1, "id", 16, 4) - centers).max() < 0.5
