"""Results on all pairs: their rows by a plain version, in an order in which files of them stay small."""

import numpy as np
from pyspark.sql import functions as F

from vecsieve.operators import encode
from vecsieve.plans import catalog


def test_rows_of_equal_codes_lie_side_by_side(spark, tmp_path):
    kinds = np.random.default_rng(5).standard_normal((30, 64))
    rows = [(i, [float(x) for x in kinds[i % 30]], i % 10) for i in range(1620)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["bow_rank"](spark, str(tmp_path)).withColumn("p", F.spark_partition_id()).toArrow()
    p, q, sim = (got[c].to_numpy() for c in ("p", "query_id", "sim"))
    turns = lambda x: ((x[1:] != x[:-1]) & (p[1:] == p[:-1])).sum()
    assert len(sim) > 100_000 and turns(sim) < len(sim) / 4 and turns(q) < len(sim) / 20


def test_copies_are_scored_once_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(encode, "COPIES", 7)
    code = [(i, w, float((i % 5 * w) % 7 - 3)) for i in range(120) for w in range(9) if (i % 5 + w) % 4 == 0 and i % 13]
    rows = spark.createDataFrame([*code, (5, 100, None)], "image_id long, word int, w double")
    sides = rows.filter("image_id < 40"), rows.filter("image_id >= 40")
    pick = lambda df: sorted(tuple(r) for r in df.collect())
    got = pick(encode.sparse_scores(*sides, ["word"], block=9, copies=True))
    held = {}
    for i, w, x in code:
        held.setdefault(i, {})[w] = x
    want = [(q, d, sum(held[q][w] * held[d][w] for w in held[q].keys() & held[d].keys())) for q in held for d in held if q < 40 <= d and held[q].keys() & held[d].keys()]
    assert got == sorted(want) and got == pick(encode.sparse_scores(*sides, ["word"], block=9))
