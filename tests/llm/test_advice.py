
import numpy as np
import pytest

from vecsieve.llm.toxicity import SIZE, LetterModel, Restorer, _trigram_rows

WORDS = "you are an idiot and a fool the loser of a damned house said merde to some other people in this river town! " * 200


@pytest.fixture(scope="module")
def read():
    counts = np.zeros(SIZE**3, np.int64)
    import pyarrow as pa

    for batch in _trigram_rows([pa.RecordBatch.from_pydict({"text": [WORDS]})]):
        counts[batch["code"].to_numpy()] = batch["n"].to_numpy()
    return Restorer(LetterModel(counts.reshape(SIZE, SIZE, SIZE)))


def test_no_disguise_is_skipped_before_the_decoder(read):
    assert "1" not in read("x 1 d 1 0 t"), "lone digits among lone letters"
    assert "0" not in read("i  d  1  0  t")
    assert read("m€rd€") == "merde"
    assert read("fooool mééééé éa") == read("fooool") + " " + read("mééééé") + " éa" and len(read("mééééé")) < 5


@pytest.mark.parametrize("said, meant", [("id10t", "idiot"), ("f00l", "fool"), ("l0$3r", "loser"), ("idio7", "idiot"), ("id-iot", "idiot"), ("(id10t),", "(idiot),"), ("idiot!", "idiot!"), ("a f00l.", "a fool."), ("i_d_i_o_t", "idiot"), ("h0u5e", "house"), ("id\u00b7iot", "idiot"), ("m€rde", "merde")])
def test_disguised_words_are_read_whole(read, said, meant):
    assert read(said) == meant


def test_no_word_of_letters_and_signs_is_skipped(read):
    import random

    rng = random.Random(8)
    asked = []
    read = Restorer(read.one.__wrapped__.__closure__[0].cell_contents)
    read._word = lambda word: asked.append(word) or word
    for _ in range(3000):
        left, right = ("".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(2))
        mark = "".join(rng.choice("0179@$!+|(€-_*.·×–/") for _ in range(rng.randint(1, 3)))
        asked.clear(), read.whole.cache_clear()
        read(f"the {left}{mark}{right} end")
        assert len(asked) == 1 and f"{left}{mark}{right}" in asked, (left, mark, right)
        mark = "".join(rng.choice("0179@$+|€") for _ in range(rng.randint(1, 3)))
        for word in (left + mark, mark + right):
            asked.clear(), read.whole.cache_clear()
            read(f"the {word} end")
            assert asked == [word], word


def test_no_length_stops_the_decoder(read):
    assert read("idi" + "o" * 300 + "t").replace("oo", "o") == "idiot"
    assert read("1d10t-" * 40).split() == ["idiot"] * 39 + ["idiot-"] or read("1d10t-" * 40).count("idiot") == 40
    said = "you are an idiot and a fool " * 20
    assert read(" ".join(said.replace(" ", ""))).split() == said.split()
    assert read("y o u i d i o t") == "you idiot"
    assert read("y o u  a r e  a n  1 d 1 0 t") == "you are an idiot"
    assert len(read("a1b" * 50000)) > 50000


def test_top_k_keeps_copies_of_queries_from_the_driver(spark):
    from vecsieve.llm.topk import top_k

    v = spark.createDataFrame([(i, [float(i % 7 == 0), float(i % 5 - 2)]) for i in range(300)], "vec_id long, embedding array<float>")
    got = top_k(v, v.filter("vec_id % 100 = 0"), block=50, query_block=2)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    score = lambda q, i: int((q % 7 == 0) * (i % 7 == 0) * 1024**2 + (q % 5 - 2) * (i % 5 - 2) * 1024**2)
    for q in (0, 100, 200):
        want = sorted((-score(q, i), i) for i in range(300) if i != q)[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
