"""Quality rules as a short-circuit cascade.

Base counts are taken for every document. The rules that follow run in the order of
rejections per second, estimated on a sample, each only on what the rules before it
left; the order changes the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .repeats import bodies

# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_GAPS = b" \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_document(flags: np.ndarray, found: A.Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[found.doc_start[1:] - 1] - sums[found.doc_start[:-1]]


def repeat_words(found: A.Words, window: int) -> np.ndarray:
    """Words of each document inside windows that the document has twice or more."""
    codes, n = found.hashes(), len(found.start)
    out = np.zeros(len(found.doc_start) - 1, np.int64)
    if n < window:
        return out
    gram = A.Rolling(codes).grams(window)
    at = np.flatnonzero(found.doc[: len(gram)] == found.doc[window - 1 :])
    value = A.mix(gram[at] + (found.doc[at].astype(np.uint64) + A.U(1)) * A.U(A.BASE))
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[hit], 1)
    np.add.at(change, at[hit] + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(found.doc[covered], minlength=len(out))


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_GAPS)]
    return len(lines) - len(set(lines))


class Page:
    """A chunk of documents with base counts; the rules read from it what they need."""

    def __init__(self, texts: list[bytes], window: int):
        self.texts = texts
        self.words = found = A.Words(texts)
        inside = np.zeros(len(found.buf) + 1, np.int64)
        np.add.at(inside, found.start, 1)
        np.add.at(inside, found.end, -1)
        starts_char = (found.buf & 0xC0) != 0x80
        self.n_words = np.diff(found.first)
        self.word_chars = _per_document((np.cumsum(inside[:-1]) > 0) & starts_char, found)
        self.n_symbols = _per_document(_IS_SYMBOL[found.buf], found)
        self.n_dup_lines = np.array([dup_lines(t) for t in texts], np.int64)
        self.n_repeat_words = repeat_words(found, window)
        self.base_failed = (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


def _symbols(page: Page, at: np.ndarray) -> np.ndarray:
    return 10 * page.n_symbols[at] > page.n_words[at]


def _lines(page: Page, at: np.ndarray) -> np.ndarray:
    lines = np.array([sum(1 for x in page.texts[i].split(b"\n") if x.strip(_GAPS)) for i in at], np.int64)
    return 2 * page.n_dup_lines[at] > lines


def _length(page: Page, at: np.ndarray) -> np.ndarray:
    chars, words = page.word_chars[at], page.n_words[at]
    return (chars < 2 * words) | (chars > 15 * words)


def _shouting(page: Page, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), bool)
    for k, i in enumerate(at):
        b = np.frombuffer(page.texts[i], np.uint8)
        upper = np.count_nonzero((b >= 65) & (b <= 90))
        out[k] = 2 * upper > upper + np.count_nonzero((b >= 97) & (b <= 122))
    return out


def _marks(page: Page, at: np.ndarray) -> np.ndarray:
    """Words that end with ``!`` make up more than 3 in 10."""
    found, out = page.words, np.zeros(len(at), bool)
    for k, i in enumerate(at):
        ends = found.end[found.first[i] : found.first[i + 1]] - 1
        out[k] = 10 * np.count_nonzero(found.buf[ends] == 33) > 3 * len(ends)
    return out


Rule = Callable[[Page, np.ndarray], np.ndarray]
RULES: dict[str, Rule] = {"symbols": _symbols, "duplicate lines": _lines, "word length": _length, "upper case": _shouting, "exclamations": _marks}


def cascade(page: Page, rules: list[Rule]) -> np.ndarray:
    """Documents that pass the base rules and all others; each rule sees those that are left."""
    left = np.flatnonzero(~page.base_failed)
    for rule in rules:
        if not len(left):
            break
        left = left[~rule(page, left)]
    kept = np.zeros(len(page.texts), bool)
    kept[left] = True
    return kept


def _pages(batches, window: int):
    for batch in batches:
        for part in A.chunks(list(zip(batch["id"].to_pylist(), bodies(batch["text"])))):
            yield [r[0] for r in part], Page([r[1] for r in part], window)


def rule_order(rows: DataFrame, rules: dict[str, Rule], window: int, sample: int) -> list[str]:
    """Names by rejections per second, measured where the rows are on about ``sample`` of them."""

    def measure(batches):
        for _, page in _pages(batches, window):
            at = np.flatnonzero(~page.base_failed)
            out = []
            for name, rule in rules.items():
                began = time.perf_counter()
                rejected = int(rule(page, at).sum()) if len(at) else 0
                out.append((name, time.perf_counter() - began, rejected))
            names, cost, hits = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(cost), pa.array(hits, pa.int64())], ["name", "cost", "rejected"])

    every = max(1, rows.count() // sample)
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    found = some.mapInArrow(measure, "name string, cost double, rejected long").groupBy("name").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"))
    rate = {r["name"]: (r["rejected"] or 0) / max(r["cost"], 1e-9) for r in found.collect()}
    return sorted(rules, key=lambda name: (-rate.get(name, 0.0), name))


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None, window: int = 8, sample: int = 2000) -> DataFrame:
    """Base counts and the cascade's verdict per input row.

    ``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``.
    A null or empty text has no words and fails; repeated rows and null ids are judged row by
    row; an empty table gives an empty result; other columns are not read. ``sample`` rows,
    about, serve to order the rules, whose verdict no order changes.
    """
    rules = RULES if rules is None else rules
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [rules[name] for name in rule_order(rows, rules, window, sample)]

    def run(batches):
        for ids, page in _pages(batches, window):
            columns = [pa.array(ids, pa.int64())] + [pa.array(getattr(page, k), pa.int64()) for k in COUNTS]
            columns += [pa.array(page.base_failed), pa.array(cascade(page, order))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *COUNTS, "base_failed", "kept"])

    schema = "id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
