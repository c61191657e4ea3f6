"""The ten operators against plain versions, on odd and on crafted tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute as B
from vecsieve.llm import chat, mixing
from vecsieve.llm.fm_index import fm_index_dedup
from vecsieve.llm.jaccard import ngram_jaccard_join
from vecsieve.llm.packing import best_fit_pack
from vecsieve.llm.quality import quality_cascade
from vecsieve.llm.repeats import Windows
from vecsieve.llm.secrets import scan_secrets
from vecsieve.llm.suffix_array import suffix_array_dedup
from vecsieve.llm.topk import top_k
from vecsieve.llm.toxicity import LetterModel, Restorer, toxicity

SCHEMA = "doc_id long, text string, source string, uid string, id int, n string, tokens string, row string, shard string, size string, score string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    shared = [" ".join(word() for _ in range(70)) for _ in range(3)]
    texts = []
    for i in range(n):
        body = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            body.insert(len(body) // 2, rng.choice(shared))
        if i % 5 == 1:
            body = texts[-1].split(" ")
            for _ in range(rng.randint(0, 4)):
                body[rng.randrange(len(body))] = word()
        texts.append(" ".join(body))
    return [*enumerate([*texts, "spam " * 200, texts[4], texts[4].upper(), "", "one two", "one two"], 1), (900, None)]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, f"s{(d or 0) % 4}" if (d or 0) % 7 else None, *["x"] * 1, 0, *["x"] * 6) for d, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (4, "w " * 30000), (5, "w " * 30000), (3, "other")]


def test_suffix_array(spark):
    rows = corpus()
    out = suffix_array_dedup(docs(spark, rows), threshold=40).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in out}
    assert got == B.op1(rows, 40)


def test_fm_index(spark):
    rows = corpus(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fm_index_dedup(docs(spark, rows), window=6).collect()}
    assert got == B.op9(rows, 6)


@pytest.mark.parametrize("limit", [1, 3])
def test_crowded_anchors_are_whole(spark, monkeypatch, limit):
    import vecsieve.llm.fm_index as f
    import vecsieve.llm.suffix_array as s

    monkeypatch.setattr(f, "Windows", lambda **k: Windows(**k, group_limit=limit, bucket_rows=5))
    monkeypatch.setattr(s, "Windows", lambda **k: Windows(**k, group_limit=limit, bucket_rows=5))
    rows = corpus(3)
    assert {r["doc_id"]: r["n_removed"] for r in fm_index_dedup(docs(spark, rows), window=6).collect()} == {d: x[1] for d, x in B.op9(rows, 6).items()}
    assert {r["doc_id"]: r["n_removed"] for r in suffix_array_dedup(docs(spark, rows), threshold=40).collect()} == {d: x[1] for d, x in B.op1(rows, 40).items()}


@pytest.mark.parametrize("room", [400, 4])
def test_ngram_join(spark, monkeypatch, room):
    import vecsieve.llm.jaccard as j

    monkeypatch.setattr(j, "ROOM", room)
    monkeypatch.setattr(j, "LEADERS", 1 if room == 4 else 16)
    rows = corpus(4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    for i in range(30):  # a chain of near copies: ends do not link
        base[rng.randrange(60)] = f"v{i}"
        rows.append((1000 + i, " ".join(base)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got == B.op10(rows)


def test_ngram_join_with_common_passages(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(60):  # near one another by the passage alone where little else is in the text
        rows.append((i, " ".join([*passages[i % 2], *(word() for _ in range(rng.choice([2, 6, 8, 9, 10, 15, 40])))])))
    for i in range(60, 80):
        body = rows[rng.randrange(60)][1].split(" ")
        body[rng.randrange(len(body))] = word()
        rows.append((i, " ".join(body)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got == B.op10(rows)


def test_packed_tokens_come_back():
    import numpy as np

    from vecsieve.llm.jaccard import _steps, _summed

    rng = np.random.default_rng(1)
    for values in ([], [0], [2**32 - 1], [5, 5, 5], np.sort(rng.integers(0, 2**32, 5000, dtype=np.uint64)).tolist()):
        short = np.array(values, np.uint32)
        assert np.array_equal(_summed(_steps(short)), short)


def test_odd_rows(spark):
    d = docs(spark, ODD)
    count = len(ODD)
    assert [r["n_removed"] for r in suffix_array_dedup(d).filter("doc_id in (4, 5)").collect()] == [60000, 60000]
    assert suffix_array_dedup(d).count() == count
    assert sorted(r["n_removed"] for r in fm_index_dedup(d).filter("doc_id in (4, 5)").collect())[1] == 30000
    joined = ngram_jaccard_join(d).collect()
    assert len(joined) == count and {r["n_shingles"] for r in joined if r["doc_id"] in (1, 2)} == {0}
    assert {r["component_id"] for r in joined if r["doc_id"] == 5} == {4}
    assert quality_cascade(d).count() == count
    assert scan_secrets(d).filter("doc_id = 1").first()["redacted"] is None
    assert mixing.mix_sources(d).count() == count
    assert best_fit_pack(d).agg(F.sum("n_words")).first()[0] == 60000 + 3 + 3 + 2 + 1
    labels = spark.createDataFrame([(3, 1), (None, 0), (4, None)], "doc_id long, toxic int")
    assert toxicity(d, labels).count() == count


def test_empty_tables(spark):
    d = docs(spark, [])
    for op in (suffix_array_dedup, fm_index_dedup, ngram_jaccard_join, quality_cascade, scan_secrets, mixing.mix_sources, best_fit_pack):
        assert op(d).count() == 0, op
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(v, v).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 320)] + [(400, None), (500, [1.0, None]), (600, [float("nan")] * 6), (700, [float("inf")] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("c", F.lit(1)).withColumn("rank", F.lit(2))
    got = top_k(v, v.filter("vec_id % 100 = 0"), block=50, query_block=2).collect()
    assert sorted(map(tuple, got)) == sorted(B.op2(rows))


def test_quality(spark):
    rows = corpus(5)
    out = quality_cascade(docs(spark, rows)).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in out} == {d: B.op4_base(t) for d, t in rows}
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 90))) for i in range(3000)]
    d = docs(spark, rows)
    out = mixing.mix_sources(d, leaf_docs=50).collect()
    assert out and sorted(out) == sorted(mixing.mix_sources(d, leaf_docs=50).collect())
    sizes, taken, target = {}, {}, {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = r["source"]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    want = B.op5_targets(sizes)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) < 0.02 * want[s] + 32 for s in want)


def test_apportionment_is_highest_quotients(spark):
    rng = random.Random(4)
    weights = [rng.randint(0, 1000) for _ in range(20)]
    rows = spark.createDataFrame([(0, i, float(w), 57) for i, w in enumerate(weights)], "g int, k int, w double, s long")
    got = {r["k"]: r["q"] for r in mixing.apportion(rows, ["g"], "k", "w", "s", "q").collect()}
    seats = sorted(((-w / (2 * j + 1), i) for i, w in enumerate(weights) for j in range(57)))[:57]
    assert got == {i: sum(1 for _, x in seats if x == i) for i in range(20)}


def test_packing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 150))) for i in range(400)] + [(i, "same text here") for i in range(400, 420)]
    out = best_fit_pack(docs(spark, rows), capacity=100).toPandas()
    source = {d: f"s{d % 4}" if d % 7 else None for d, _ in rows}
    assert out.groupby("doc_id").n_words.sum().to_dict() == {d: len(t.split()) for d, t in rows}
    for _, b in out.groupby(["shard", "bin"]):
        b = b.sort_values("start")
        assert b.start.tolist() == (b.n_words.cumsum() - b.n_words).tolist() and b.n_words.sum() <= 100
        named = [source[d] for d in b.doc_id if source[d]]
        assert len(named) == len(set(named)) and sum(d >= 400 for d in b.doc_id) <= 1


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|end|> <\\|turn|>"), (1, 1, "assistant", "  yes\n<|body|>é😀 "), (1, 2, "assistant", ""), (2, 0, None, None), (2, 0, "assistant", "</s>[INST] ok")]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r["conv_id"]: tuple(r)[1:5] for r in out.collect()} == B.op7(rows)


def test_secrets(spark):
    key = hashlib.sha1(b"1").hexdigest()
    rows = [(1, f'x token = "{key}" y'), (2, f"commit {key} done"), (3, "card 9807915762804490 ok"), (4, f"TOKEN = \"{key.upper()}\"!!"), (5, "see https://a.com/some-long-page-name-2024")]
    got = {r["doc_id"]: (r["n_secrets"], r["redacted"]) for r in scan_secrets(docs(spark, rows)).collect()}
    assert [got[i][0] for i in range(1, 6)] == [1, 0, 0, 1, 0] and key not in got[1][1] and got[3][1] == rows[2][1]


def test_deobfuscation_and_held_out(spark):
    import zlib

    import numpy as np

    from vecsieve.llm.toxicity import letter_model

    rng = random.Random(6)
    words = ["the", "tree", "house", "river", "stone", "idea", "other", "diet", "patio"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        body = [rng.choice(words) for _ in range(40)]
        if toxic:
            body.insert(10, rng.choice(["idiot", "idiot", "1d10t", "i d i o t", "IDIOOOT"]))
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    d = docs(spark, rows)
    read = Restorer(letter_model(d))
    assert isinstance(read, Restorer) and np.isfinite(LetterModel(np.zeros((64, 64, 64))).logp).all()
    assert [read(x) for x in ("1d10t", "i d i o t")] == ["idiot", "idiot"]
    out = toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    right = [r["predicted"] == labels[r["doc_id"]][1] for r in out if r["held_out"]]
    assert sum(right) > 0.95 * len(right)
