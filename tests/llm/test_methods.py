"""The operators' own parts against plain versions: indexes, packing, forests, lessons."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import docs
from vecsieve.llm import packing, secrets
from vecsieve.llm.fm_index import FMIndex
from vecsieve.llm.suffix_array import radix_groups
from vecsieve.llm.toxicity import letter_model, toxicity


def test_matching_statistics_and_places():
    rng = np.random.default_rng(5)
    pieces = [rng.integers(0, 3, n).tolist() for n in rng.integers(6, 14, 40)]
    times = rng.integers(1, 3, 40)
    index = FMIndex(np.concatenate([np.array(p) for p in pieces]), np.array([len(p) for p in pieces]), times, 3)
    ends = [(k, e) for k, p in enumerate(pieces) for e in range(5, len(p) + 1)]
    stat, low, high = index.statistics(np.array([index.start[k] + e for k, e in ends]), 5)
    count = lambda x: sum(int(t) * sum(p[i : i + len(x)] == x for i in range(len(p) - len(x) + 1)) for p, t in zip(pieces, times))
    for (k, e), s, lo, hi in zip(ends, stat, low, high):
        best = max((n for n in range(1, 6) if count(pieces[k][e - n : e]) > 1), default=0)
        assert s == best
        match = pieces[k][e - s : e]
        places = sorted(int(index.start[j]) + i for j, p in enumerate(pieces) for i in range(len(p) - s + 1) if p[i : i + s] == match)
        assert s == 0 or sorted(index.locate(np.arange(lo, hi)).tolist()) == places
    full = np.flatnonzero(stat == 5)
    assert index.earliest(low[full], high[full]).tolist() == [min(index.locate(np.arange(a, b))) for a, b in zip(low[full], high[full])]


def test_radix_passes_are_repeated_windows():
    rng = np.random.default_rng(6)
    body = rng.integers(97, 99, 300).astype(np.uint8)
    suffix = np.arange(len(body) - 12)
    texts = [bytes(body[i : i + 12]) for i in suffix]
    times = rng.integers(1, 2, len(suffix))
    times[:20] = 2
    got = radix_groups(np.zeros(len(suffix), np.int64), suffix, times, body, 12, 5)
    assert got.tolist() == [i for i, t in enumerate(texts) if sum(int(n) for n, x in zip(times, texts) if x == t) > 1]


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 60), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, None, 7, 8]), 0) for i in range(300)]
    table = pa.table({k: pa.array([r[j] for r in rows], pa.int64()) for j, k in enumerate(["row", "n_words", "source_key", "cluster", "shard"])})
    got = packing._pack(50)(table).to_pylist()
    assert sorted((r["row"], r["piece"]) for r in got) == sorted((i, k) for i, n, *_ in rows for k in range(-(-n // 50)))
    bins: dict[int, list] = {}
    by_row = {r[0]: r for r in rows}
    for r in got:
        _, n, source, cluster, _ = by_row[r["row"]]
        if r["piece"] != n // 50 or n % 50 == 0:
            continue
        fits = {b: 50 - sum(x[0] for x in held) for b, held in bins.items() if all(not (source is not None and source == x[1]) and not (cluster is not None and cluster == x[2]) for x in held)}
        fits = {b: left for b, left in fits.items() if left >= n % 50}
        assert 50 - r["start"] == min(fits.values()) if fits else r["start"] == 0
        bins.setdefault(r["bin"], []).append((n % 50, source, cluster))


def test_null_ids_of_one_size_are_packed(spark):
    from vecsieve.llm.packing import best_fit_pack

    out = best_fit_pack(docs(spark, [(None, "a b"), (None, "a c"), (3, "d e"), (0, "f g")])).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["0", "3", "None", "None"]


def test_forest_on_held_out_findings(spark):
    texts = [(i, "the river and the old stone house near a quiet garden were seen by other people in that letter " * 3) for i in range(5)]
    known = secrets.dictionary(docs(spark, texts))
    assert {"river", "garden"} <= known.known and known.covered("riverx") == 5
    learn, held = secrets.split_findings(secrets.labelled_findings(known.words))
    precision, recall = secrets.quality(secrets.train(learn, known), known, held)
    assert precision > 0.95 and recall > 0.9


@pytest.mark.parametrize("text, secret", [
    ('x password = "hunter2!" y', b"hunter2!"), ("key: abcdefghijklmnopqrstuvwx", b"abcdefghijklmnopqrstuvwx"), ("token xoxb-1234-abcd end", b"xoxb-1234-abcd"),
    ("a\n-----BEGIN RSA PRIVATE KEY-----\nMIIE\nabc\n-----END RSA PRIVATE KEY-----\nb", b"-----BEGIN RSA PRIVATE KEY-----\nMIIE\nabc\n-----END RSA PRIVATE KEY-----"),
])
def test_short_letters_only_and_blocks_are_candidates(text, secret):
    raw = text.encode()
    assert secret in [raw[s:e] for s, e in secrets.candidates(raw)]


def test_label_bound_holds_for_repeated_ids(spark):
    rng = random.Random(1)
    said = lambda bad: " ".join([*(rng.choice(["river", "stone", "tree"]) for _ in range(12)), *(["idiot"] if bad else [])])
    rows = [(i % 7, said(i % 7 < 3)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(7)], "doc_id long, toxic int")
    few = toxicity(docs(spark, rows), labels, most_labels=20).collect()
    assert len(few) == 200 and all(0 <= r["score"] <= 1 for r in few)
    assert letter_model(docs(spark, rows)).logp.shape == (64, 64, 64)


def test_pieces_do_not_grow_with_words():
    from vecsieve.llm.repeats import short_words

    long = b"x" * 65
    got = short_words(b"a  " + long + b"\t" + b"y" * 64 + b" " + long + b"x")
    assert got[0] == b"a" and got[2] == b"y" * 64
    assert got[1] == short_words(long)[0] != got[3] and len(got[1]) == len(got[3]) == 17
