"""Stages of the pipeline on null and repeated ids, row by row."""

import hashlib
from collections import Counter

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["river", "stone", "tree", "house", "table", "window", "garden", "street"]


def body(i, n=30):
    return " ".join(f"{WORDS[(i * 7 + j * (i + 1)) % 8]}{chr(97 + (i + j) % 26)}" for j in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], SCHEMA)


def texts(out):
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_secret_of_one_row_stays_in_it(spark):
    key = hashlib.sha1(b"1").hexdigest()
    told = f'x token = "{key}" y'
    rows = [(None, told, "a"), (None, body(1), "a"), (5, body(2), "b"), (5, told, "b"), (6, body(3), "c")]
    got = texts(P.no_secrets(spark, docs(spark, rows), ""))
    assert got == Counter((d, t.replace(key, "[SECRET]")) for d, t, _ in rows)


def test_one_row_of_each_group(spark):
    rows = [(None, body(1), "a"), (None, body(1), "a"), (None, body(2), "a"), (5, body(3), "b"), (5, body(3), "b"), (5, body(2), "b"), (6, body(4), "b")]
    got = texts(P.one_of_each(spark, docs(spark, rows), ""))
    assert got == Counter([(None, body(1)), (None, body(2)), (5, body(3)), (6, body(4))])


def test_toxic_rows_go_one_by_one(spark, tmp_path):
    rows = [(i, body(i) + (" idiot moron idiot" if i % 3 == 0 else ""), "a") for i in range(300)]
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(d, t, "a") for d in (None, 900) for t in (body(901), body(902) + " idiot moron idiot")]
    got = texts(P.not_toxic(spark, docs(spark, rows + odd), str(tmp_path)))
    assert {k: n for k, n in got.items() if k[0] in (None, 900)} == {(d, body(901)): 1 for d in (None, 900)}


def test_rows_of_one_id_are_mixed_by_their_own_sizes(spark):
    from vecsieve.llm.mixing import mix_sources

    rows = [(d, body(i, 5 + i), s) for i, (d, s) in enumerate([(None, "a"), (None, "b"), (5, "a"), (5, "b"), (5, "c"), (6, "c")] * 5)]
    out = P.mixed(spark, docs(spark, rows), "")
    taken = sum(r["taken"] for r in mix_sources(P.numbered(spark, docs(spark, rows)), id_col="_row").collect())
    got = [r["text"] for r in out.collect()]
    assert sum(len(t.split()) for t in got) == taken
    assert all(any(t.startswith(g) for _, t, _ in rows) for g in got)
