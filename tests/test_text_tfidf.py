"""Weights of all words of documents against a plain version."""

import math
import re
from collections import Counter

import pytest

from vecsieve.plans import catalog


def test_every_word_is_weighed(spark, tmp_path):
    texts = {i: " ".join([f"Common, word{chr(97 + i % 26)}{chr(97 + i // 26)}x"] * (1 + i % 3)) for i in range(600)} | {600: None, 601: "rareword", 602: "..."}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    tf = {i: Counter(w for w in re.split("[^a-z]+", (t or "").lower()) if w) for i, t in texts.items()}
    df = Counter(w for words in tf.values() for w in words)
    assert len(df) > 500
    want = {}
    for i, words in tf.items():
        x = {w: n * math.log(len(texts) / df[w]) for w, n in words.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        want |= {(i, w): v / norm if norm else 0.0 for w, v in x.items()}
    got = {(r["image_id"], r["word"]): r["w"] for r in catalog.QUERIES["text_tfidf_all"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
