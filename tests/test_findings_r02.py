"""Queries on pairs of vectors: their rows by a plain version, on repeated and null vectors, and nothing of the size of the pairs in a shuffle or a broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsieve.operators import metrics, mining, search
from vecsieve.plans import catalog, catalog_more  # noqa: F401
from vecsieve.plans.views import Views, grades


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    kinds = np.round(rng.standard_normal((40, 64)) * 8) / 8
    rows = [(i, [float(x) for x in kinds[i % 40 if i % 3 else 7]], int(kinds[i % 40][0] > 0) + 3 * (i % 11 == 0)) for i in range(220)]
    rows = [(i, None if i in (31, 50) else v, label if i != 44 else None) for i, v, label in rows]
    rows[73] = (73, [None, *rows[73][1][1:]], rows[73][2])
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def table(spark, folder):
    rows = {r["id"]: r for r in Views(spark, folder).every.collect()}
    fine = {i: np.array(r["vec"]) for i, r in rows.items() if r["vec"] is not None and None not in r["vec"]}
    return rows, fine


def order(fine, q, ids):
    return sorted(ids, key=lambda i: (-float(fine[q] @ fine[i]), i))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lean(df):
    return not any(x in plan(df) for x in ("Join", "Window"))


def ranking(spark, folder):
    rows, fine = table(spark, folder)
    return rows, {q: order(fine, q, [i for i in fine if i % 10]) for q in fine if q % 10 == 0}


def test_ranks_are_made_where_scores_are(spark, folder):
    got = catalog.QUERIES["exact_rank"](spark, folder)
    assert lean(got)
    _, want = ranking(spark, folder)
    assert {(r["query_id"], r["image_id"], r["rank"]) for r in got.collect()} == {(q, i, n) for q, ids in want.items() for n, i in enumerate(ids)}


def test_many_blocks_and_files(spark, folder, monkeypatch):
    want = {tuple(r) for r in catalog.QUERIES["exact_rank"](spark, folder).collect()}
    parts = search._visits
    monkeypatch.setattr(search, "QUERY_VALUES", 256)

    def small(make, names):
        def run(batches):
            search.HELD_VALUES, search.HELD_SCORES = 64, 512
            yield from parts(make, names)(batches)

        return run

    monkeypatch.setattr(search, "_visits", small)
    got = catalog.QUERIES["exact_rank"](spark, folder)
    assert got.rdd.getNumPartitions() > 4 and {tuple(r) for r in got.collect()} == want


def test_queries_of_one_id_have_one_ranking(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<double>")
    base = spark.createDataFrame([(5, [2.0, 1.0]), (3, [1.0, 1.0])], "id long, vec array<double>")
    got = sorted((r["rank"], r["image_id"], r["sim"]) for r in search.rank(rows, base).collect())
    assert got == [(0, 5, 2.0), (1, 3, 1.0), (2, 3, 1.0), (3, 5, 1.0)]


def test_places_and_best():
    s = np.array([1.0, 3.0, np.nan, 3.0, -2.0, 1.0])
    assert search.descending(s).tolist() == [2, 1, 3, 0, 5, 4] and search.best(s, 2).tolist() == [2, 1] and search.best(s[3:], 2).tolist() == [0, 2]
    assert search.places(s, np.array([5, 4, 3])).tolist() == [4, 5, 2] and search.places(s[3:], np.array([2, 0, 1])).tolist() == [1, 0, 2]


def test_knn_map(spark, folder):
    got = catalog.QUERIES["knn_map"](spark, folder)
    assert lean(got)
    rows, fine = table(spark, folder)
    each = []
    for q in fine:
        places = [n for n, i in enumerate(order(fine, q, [i for i in fine if i != q]), 1) if rows[i]["label"] == rows[q]["label"] is not None]
        each += [np.mean([j / n for j, n in enumerate(places, 1)])] if places else []
    assert got.first()[0] == pytest.approx(np.mean(each), abs=1e-6)


def test_nearest_other(spark, folder):
    near = mining.nearest_other(Views(spark, folder).every)
    assert lean(near)
    _, fine = table(spark, folder)
    assert {r["query_id"]: r["image_id"] for r in near.collect()} == {q: order(fine, q, [i for i in fine if i != q])[0] for q in fine}


def test_blocks_of_many_queries(spark):
    """Copies of the database are as many as tasks run at a time, not as many as blocks of 8 MB."""
    rows = spark.range(3072).select("id", F.array_repeat(F.lit(1.0), 4096).alias("vec"))
    line = next(x for x in plan(mining.nearest_other(rows)).splitlines() if "RepartitionByExpression" in x)
    assert int(line.rsplit(",", 1)[1]) == 2 * spark.sparkContext.defaultParallelism


def mined(spark, folder):
    rows, want = ranking(spark, folder)
    out = {}
    for q, ids in want.items():
        first = {}
        for i in ids:
            a, b = rows[i]["label"], rows[q]["label"]
            if a is not None and b is not None and a != b:
                first.setdefault(a, i)
        for n, i in enumerate(sorted(first.values(), key=ids.index)[:5], 1):
            out[q, n] = i, rows[i]["label"]
    return out


def test_mined_where_scores_are(spark, folder):
    got = catalog.QUERIES["mine_negatives"](spark, folder)
    assert lean(got)
    assert {(r["query_id"], r["rank"]): (r["image_id"], r["cluster"]) for r in got.collect()} == mined(spark, folder)


def test_loss_joins_tuples_only(spark, folder):
    got = catalog.QUERIES["contrastive_loss"](spark, folder)
    assert "Window" not in plan(got)
    assert {r["query_id"] for r in got.collect()} <= {q for q, _ in mined(spark, folder)}


def by_rows(spark, folder):
    v = Views(spark, folder)
    return v, search.rank(v.queries, v.database)


def same(got, want, *names):
    pick = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) and x == x else str(x) for x in r) for r in df.select(*names).collect())
    assert pick(got) == pick(want)


@pytest.mark.parametrize("name", ["precision_at_k", "query_ap", "eval_protocols", "typical_query", "filtered_positions"])
def test_no_pairs_become_rows(spark, folder, name):
    tree = plan(catalog.QUERIES[name](spark, folder))
    assert "Window" not in tree and "Join" not in tree[tree.rindex("RepartitionByExpression") :] and tree.count("MapInArrow") == 1 + (name == "typical_query")


def test_typical_query_scores_once(spark, folder):
    got = catalog.QUERIES["typical_query"](spark, folder)
    got.collect()
    tree = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert tree.count("MapInArrow") == 1 and "ReusedExchange" in tree


def test_metrics_by_rule(spark, folder):
    v, ranked = by_rows(spark, folder)
    same(metrics.query_metrics_by(v.queries, v.database, grades), metrics.query_metrics(ranked, v.truth, v.query_ids), "protocol", "query_id", "n_positive", "ap", "precision")


def test_positions_by_rule(spark, folder):
    v, ranked = by_rows(spark, folder)
    same(metrics.filtered_positions_by(v.queries, v.database, grades), metrics.filtered_positions(ranked, v.truth), "protocol", "query_id", "image_id", "pos")


def test_status_by_rule(spark, folder):
    v, ranked = by_rows(spark, folder)
    got = catalog.QUERIES["result_status"](spark, folder)
    assert lean(got)
    same(got, metrics.result_status(ranked.filter("rank < 8"), v.truth, "medium"), "query_id", "image_id", "rank", "status")


def test_sets_without_a_distinct_over_pairs(spark, folder):
    got = catalog.QUERIES["protocol_sets"](spark, folder)
    tree = plan(got)
    assert not tree[: tree.index("Join")].count("Aggregate") and "_s#" in tree
    v = Views(spark, folder)
    want = v.queries.select(F.col("id").alias("query_id"), "label").join(v.database.select(F.col("id").alias("image_id"), "label"), "label").count()
    assert got.count() == 3 * want and got.distinct().count() == 3 * want


def test_sparse_scores_join_nothing(spark):
    from vecsieve.operators import encode

    code = [(i, w, float((i * w) % 7 - 3)) for i in range(60) for w in range(9) if (i + w) % 4 == 0]
    rows = spark.createDataFrame(code, "image_id long, word int, w double")
    got = encode.sparse_scores(rows.filter("image_id < 20"), rows.filter("image_id >= 20"), ["word"], block=5)
    assert "Join" not in plan(got)
    held = {}
    for i, w, x in code:
        held.setdefault(i, {})[w] = x
    want = {(q, d): sum(held[q][w] * held[d][w] for w in held[q].keys() & held[d].keys()) for q in held for d in held if q < 20 <= d and held[q].keys() & held[d].keys()}
    assert {(r["query_id"], r["image_id"]): r["sim"] for r in got.collect()} == want


def test_words_are_counted_once(spark, folder):
    spark.createDataFrame([(i, f"some words {'more ' * i} again") for i in range(5)], "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    tree = plan(catalog.QUERIES["text_tfidf_all"](spark, folder))
    assert tree.count("Join") == 1 and tree.lower().count("distinct") == 0
