"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all texts. Words that may be disguised
(with digits, signs or separators anywhere, runs of a letter, letters set apart by spaces) become
lattices of what their characters may stand for; Viterbi decoding picks the likeliest
reading. The restored text is scored by a logistic model of words and word beginnings,
fitted on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import Cuts

# Letters that a sign or digit may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e"}
SIZE = 64
_EDGE = 0
_SIGNS = "@$!+|(€"
_MARKS = re.compile(rf"^[^\w{_SIGNS}]+|[^\w{_SIGNS}]+$")  # around a word; what stands for no letter
_DISGUISED = re.compile(r"(?=.*[^\W\d_])(?:.*[\W\d_]|.*([^\W\d_])\1\1)", re.S)
_SPACED = re.compile(r"(?<![^\s])(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?![^\s])")
_INNER = np.zeros((3, 256), bool)  # bytes of letters, of ASCII signs and digits, of other characters than ASCII and Latin letters
_INNER[0][[*range(97, 123), *range(128, 256)]] = True
_INNER[1][[c for c in range(33, 127) if not 97 <= c <= 122]] = True
_INNER[2][[0xC2, *range(0xCB, 256)]] = True
_ENDING = np.zeros(256, bool)
_ENDING[list(b"0123456789@$!+|(_")] = True
PREFIXES = (4, 5, 6, 7, 8)
FEATURE_BITS = 24
CACHED = 64  # longer words are decoded each time


def letter(ch: str) -> int:
    """Class of a character: a to z by themselves, digits, signs that are no punctuation, others in folds."""
    code = ord(ch)
    if ch in "@$€":
        return 58
    if code > 127:
        return 27 + code % 30
    return code - 96 if 97 <= code <= 122 else 57 if 48 <= code <= 57 else 59 + code % 5


class LetterModel:
    """Interpolated trigram log-probabilities of character classes; class 0 is a word's edge."""

    def __init__(self, trigrams: np.ndarray):
        t = trigrams.astype(np.float64)
        two, one = t.sum(0), t.sum((0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * SIZE)
        p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
        p3 = (t + 8 * p2[None]) / (t.sum(2, keepdims=True) + 8)
        self.logp = np.log(p3).astype(np.float32)
        self.rows: list | None = None

    def decode(self, choices: list[list[tuple[str, float]]]) -> str:
        """Viterbi over a lattice of (string of 0 to 2 letters, log channel probability) per position."""
        self.rows = logp = self.rows or self.logp.tolist()
        states: dict[tuple[int, int], tuple[float, tuple]] = {(_EDGE, _EDGE): (0.0, ())}
        for options in choices:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, said) in states.items():
                for text, channel in options:
                    x, y, total = a, b, score + channel
                    for ch in text:
                        c = _EDGE if ch == " " else letter(ch)
                        if c != _EDGE or (x, y) != (_EDGE, _EDGE):
                            total += logp[x][y][c]
                        x, y = (y, c) if c != _EDGE else (_EDGE, _EDGE)
                    if (x, y) not in after or total > after[x, y][0]:
                        after[x, y] = (total, (said, text))
            states = after
        said = max(((s + logp[a][b][_EDGE] * ((a, b) != (_EDGE, _EDGE)), said) for (a, b), (s, said) in states.items()), key=lambda x: x[0])[1]
        parts = []
        while said:
            said, text = said
            parts.append(text)
        return "".join(reversed(parts))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of one character: itself, what it may stand for, nothing or a word's edge for separators, one or two for many.

    Signs that often stand before or after words are rather themselves there.
    """
    out = []
    tail = len(word.rstrip("!|+"))
    for m in re.finditer(r"(.)\1*", word, re.S):
        ch, n = m[1], len(m[0])
        reads = STANDS_FOR.get(ch)
        if reads:
            plain = m.start() >= tail or m.start() == 0 and ch in "(|+@$"
            say, keep = (0.02, 0.9) if plain else (0.6, 0.05)
            out += [[(r, math.log(say / len(reads))) for r in reads] + [(ch, math.log(keep))]] * n
        elif not ch.isalnum():
            out += [[("", math.log(0.6)), (" ", math.log(0.3)), (ch, math.log(0.05))]] * n
        elif n > 2:
            out.append([(ch, math.log(0.5)), (ch * 2, math.log(0.4))])
        else:
            out.append([(ch * n, 0.0)])
    return out


def spaced(text: str) -> list[list[tuple[str, float]]]:
    """Readings of letters set apart: a gap may be a word's edge, and rather is where others are narrower."""
    letters, gaps = re.findall(r"[^ .\-_*]", text), re.findall(r"[ .\-_*]+", text)
    least = min(map(len, gaps))
    out, start = [], 0
    for i in range(1, len(letters) + 1):
        wide = i < len(letters) and len(gaps[i - 1]) > least
        if i < len(letters) and letters[i] == letters[start] and not wide:
            continue
        out += lattice(letters[start] * (i - start))
        if i < len(letters):
            edge = 0.9 if wide else 0.2
            out.append([("", math.log(1 - edge)), (" ", math.log(edge))])
        start = i
    return out


def _odd(b: np.ndarray) -> np.ndarray:
    """Bytes of words that may be disguised: of all that ``_DISGUISED`` matches, and of some others."""
    letter, sign, other = (row[b] for row in _INNER)
    n = len(b) - 6
    same = b[:-2] == b[2:]
    odd = sign[:n] & (letter[1 : n + 1] | sign[1 : n + 1]) | other[:n]
    odd[1:] |= letter[: n - 1] & _ENDING[b[1:n]]
    odd |= (b[:n] == 0xC3) & ((b[1 : n + 1] == 0x97) | (b[1 : n + 1] == 0xB7))
    odd |= letter[:n] & (b[:n] == b[1 : n + 1]) & (b[:n] == b[2 : n + 2])
    return odd | letter[:n] & same[:n] & same[1 : n + 1] & same[2 : n + 2] & same[3 : n + 3]


class Restorer:
    def __init__(self, model: LetterModel):
        self.model = model
        self.one = lru_cache(1 << 16)(lambda word: model.decode(lattice(word)))
        self.whole = lru_cache(1 << 16)(lambda word: re.sub(r"\S+", lambda m: self._token(m[0]), word))

    def __call__(self, text: str) -> str:
        """Lower-cased text whose disguised words, of any length, are decoded."""
        low = _SPACED.sub(lambda m: self._apart(m[0]), text.lower())
        raw = low.encode("utf-8", "replace")
        at = np.flatnonzero(_odd(np.frombuffer(b" " + raw + b"      ", np.uint8)))
        if not len(at):
            return low
        found = A.Words([raw])
        hit = np.unique(np.searchsorted(found.start, at, side="right") - 1)
        parts, last = [], 0
        for s, e in zip((found.start[hit] - 1).tolist(), (found.end[hit] - 1).tolist()):
            whole = self.whole if e - s <= CACHED else self.whole.__wrapped__
            parts += [raw[last:s].decode("utf-8", "replace"), whole(raw[s:e].decode("utf-8", "replace"))]
            last = e
        return "".join([*parts, raw[last:].decode("utf-8", "replace")])

    def _token(self, word: str) -> str:
        core = _MARKS.sub("", word)
        if not _DISGUISED.match(core):
            return word
        at = word.index(core)
        return word[:at] + self._word(core) + word[at + len(core) :]

    def _word(self, word: str) -> str:
        return self.one(word) if len(word) <= CACHED else self.one.__wrapped__(word)

    def _apart(self, text: str) -> str:
        return self.model.decode(spaced(text)) if any(c.isalpha() for c in text) else text


def _class_table() -> np.ndarray:
    return np.array([_EDGE if chr(i).isspace() else letter(chr(i).lower()[0]) for i in range(0x3000)], np.int64)


def _trigram_rows(batches):
    table = _class_table()
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for text in batch["text"].to_pylist():
            if text:
                code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
                for at in range(0, len(code), A.SEGMENT):
                    some = code[max(0, at - 2) : at + A.SEGMENT]
                    c = np.where(some < len(table), table[np.minimum(some, len(table) - 1)], 27 + some % 30)
                    c = c if at else np.concatenate([[0, 0], c, [0]])
                    # a word's first letters see an edge only
                    prior = np.where(c[1:-1] == _EDGE, _EDGE, c[:-2])
                    keep = ~((c[1:-1] == _EDGE) & (c[2:] == _EDGE))
                    # a disguise teaches no spelling: digits and signs beside letters do not count
                    sign, plain = (c == 57) | (c == 58), (c > 0) & (c < 57)
                    odd = sign[1:] & plain[:-1] | plain[1:] & sign[:-1]
                    keep &= ~(odd[1:] | odd[:-1])
                    total += np.bincount(((prior * SIZE + c[1:-1]) * SIZE + c[2:])[keep], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])


def letter_model(docs: DataFrame, text_col: str = "text") -> LetterModel:
    """Trigram counts of all texts; at most 64 cubed rows reach the driver, as Arrow columns."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_trigram_rows, "code int, n long")
    found = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, np.int64)
    counts[found["code"].to_numpy()] = found["n"].to_numpy()
    return LetterModel(counts.reshape(SIZE, SIZE, SIZE))


def _trimmed(found: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without ASCII signs around them."""
    sign = np.ones(256, bool)
    sign[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
    n = len(found.buf)
    hard = np.where(~sign[found.buf], np.arange(n), n)
    next_hard = np.minimum.accumulate(hard[::-1])[::-1]
    last_hard = np.maximum.accumulate(np.where(~sign[found.buf], np.arange(n), -1))
    s = np.minimum(next_hard[found.start], found.end) if len(found.start) else found.start
    e = np.maximum(last_hard[found.end - 1] + 1, s) if len(found.end) else found.end
    return s, e


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word beginnings: documents, features, counts; words per document. ``wanted`` marks those to count."""
    found = A.Words([t.encode("utf-8", "replace") for t in texts])
    s, e = _trimmed(found)
    roll = A.Rolling(A.BYTE_CODE[found.buf])
    docs, values = [], []
    for k in (*PREFIXES, 0):
        ok = np.flatnonzero(e - s >= k if k else e > s)
        h = roll.of(s[ok], s[ok] + k if k else e[ok])
        value = ((h if k else A.mix(h + A.U(1))) >> A.U(64 - FEATURE_BITS)).astype(np.int64)
        if wanted is not None:
            keep = wanted[value]
            ok, value = ok[keep], value[keep]
        docs.append(found.doc[ok])
        values.append(value)
    pair, n = np.unique((np.concatenate(docs) << FEATURE_BITS) | np.concatenate(values), return_counts=True)
    return pair >> FEATURE_BITS, pair & ((1 << FEATURE_BITS) - 1), n, np.diff(found.first)


class Scorer:
    """Logistic model of feature densities."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.wanted: np.ndarray | None = None

    @staticmethod
    def density(n: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.log1p(300.0 * n / (words + 30.0))

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.wanted is None:
            self.wanted = np.zeros(1 << FEATURE_BITS, bool)
            self.wanted[self.names] = True
        d, f, n, words = features(texts, self.wanted)
        total = np.full(len(texts), self.bias)
        if len(self.names) and len(f):
            at = np.minimum(np.searchsorted(self.names, f), len(self.names) - 1)
            ok = self.names[at] == f
            total += np.bincount(d[ok], self.weights[at[ok]] * self.density(n[ok], words[d[ok]]), minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit(sizes: np.ndarray, f: np.ndarray, n: np.ndarray, words: np.ndarray, labels: np.ndarray, keep: int = 3000, steps: int = 400) -> Scorer:
    """Features by chi-square among those of three toxic rows or more, then ridge logistic regression.

    Row i has the next ``sizes[i]`` of the features ``f`` with counts ``n``, and ``words[i]`` words.
    """
    prior = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    blank = Scorer(np.zeros(0, np.int64), np.zeros(0), math.log(prior / (1 - prior)))
    if not len(labels) or labels.min() == labels.max():
        return blank
    toxic = np.repeat(labels > 0, sizes)
    names, hit = np.unique(f[toxic], return_counts=True)
    names, hit = names[hit >= 3], hit[hit >= 3]
    if not len(names):
        return blank
    at = np.minimum(np.searchsorted(names, f), len(names) - 1)
    ok = names[at] == f
    d, at, n = np.repeat(np.arange(len(sizes)), sizes)[ok], at[ok], n[ok]
    expected = np.bincount(at, minlength=len(names)) * prior
    chi = np.where(hit > expected, (hit - expected) ** 2 / (expected * (1 - prior)), 0.0)
    best = np.sort(np.argsort(-chi, kind="stable")[: min(keep, int((chi > 6).sum()))])
    if not len(best):
        return blank
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    ok = place[at] >= 0
    d, at = d[ok], place[at[ok]]
    v = Scorer.density(n[ok], words[d])
    weights, bias = np.zeros(len(best)), blank.bias
    grad2, bias2 = np.full(len(best), 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(d, weights[at] * v, minlength=len(sizes)), -30, 30)))
        miss = p - labels
        grad = np.bincount(at, miss[d] * v, minlength=len(best)) + 0.3 * weights
        grad2 += grad**2
        bias2 += miss.sum() ** 2
        weights -= 0.3 * grad / np.sqrt(grad2)
        bias -= 0.3 * miss.sum() / math.sqrt(bias2)
    return Scorer(names[best].astype(np.int64), weights, bias)


LESSON = "place long, id long, toxic int, f binary, n binary, words long"


def _lessons(model: LetterModel):
    """Features of labelled rows."""

    def run(batches):
        read = Restorer(model)
        for batch in batches:
            for place, id_, toxic, text in zip(*(batch[k].to_pylist() for k in ("place", "id", "toxic", "text"))):
                _, f, n, words = features([read(text or "")])
                row = (place, id_, toxic, f.astype(np.int32).tobytes(), n.astype(np.uint32).tobytes(), int(words[0]))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [x.split()[0] for x in LESSON.split(", ")])

    return run


def _fitted(batches):
    """One task's rows, the bounded sample, as a model: the bias under the feature -1, then the weights."""
    rows = sorted(r for batch in batches for r in zip(*(batch[k].to_pylist() for k in ("place", "id", "toxic", "f", "n", "words"))))
    f, n = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((3, np.int32), (4, np.uint32)))
    sizes = np.array([len(r[3]) // 4 for r in rows], np.int64)
    scorer = fit(sizes, f, n, np.array([r[5] for r in rows], float), np.array([float(r[2] == 1) for r in rows]))
    names, weights = np.concatenate([[-1], scorer.names]), np.concatenate([[scorer.bias], scorer.weights])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(weights, pa.float64())], ["name", "weight"])


def learn(cuts: Cuts, rows: DataFrame, known: DataFrame, model: LetterModel, most: int, seed: int) -> Scorer:
    """The scorer of at most ``most`` distinct pairings of a text and a label, least by a seeded hash.

    Texts are decoded where they are; the bounded sample is fitted in one task, and only the model comes to the driver.
    """
    place = F.xxhash64(F.lit(seed), "id").alias("place")
    lessons = rows.join(F.broadcast(known), "id").select(place, "id", "toxic", "text").mapInArrow(_lessons(model), LESSON)
    told = cuts.cut(cuts.cut(lessons).distinct().orderBy("place", "id", "toxic", "f", "n").limit(most))
    got = told.coalesce(1).mapInArrow(_fitted, "name long, weight double").toArrow()
    names, weights = got["name"].to_numpy(), got["weight"].to_numpy()
    return Scorer(names[1:], weights[1:], float(weights[0])) if len(names) else Scorer(np.zeros(0, np.int64), np.zeros(0), math.log(1e-3 / (1 - 1e-3)))


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most_labels: int = 6000, seed: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """``(id, held_out, score, predicted)`` per input row, and its columns ``carry``.

    The letter model counts all texts. The scorer is fitted on at most ``most_labels``
    labels, least by a seeded hash, whose id is not held out, and on as many pairings of
    these with a text; only restored text is an input. Texts of any length are decoded and
    scored whole. Null and empty texts get the model's score of no words. Null labels and ids
    teach nothing; where an id repeats in either table, each different pairing teaches once; null ids are
    not held out; without labels of both kinds scores are the labels' share; an empty table gives an empty result;
    other columns are not read.
    """
    cuts = Cuts(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    restore = Restorer
    model = letter_model(rows)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("id is not null and toxic is not null").filter(~held_out("id")).distinct()
    known = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "toxic").limit(most_labels)
    scorer = learn(cuts, rows, known, model, most_labels, seed)

    def run(batches):
        read = restore(model)
        for batch in batches:
            texts = [read(t or "") for t in batch["text"].to_pylist()]
            ids = batch["id"].to_pylist()
            for part in A.chunks(list(zip(range(len(texts)), texts))):
                columns = [pa.array([ids[i] for i, _ in part], pa.int64()), pa.array(scorer([t for _, t in part]))]
                columns += [batch[f"carry_{c}"].slice(part[0][0], len(part)) for c in carry]
                yield pa.RecordBatch.from_arrays(columns, ["id", "score", *(f"carry_{c}" for c in carry)])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    kinds = [f"carry_{c} {docs.schema[c].dataType.simpleString()}" for c in carry]
    out = given.mapInArrow(run, ", ".join(["id long", "score double", *kinds]))
    kept = F.coalesce(held_out("id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), kept.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"carry_{c}").alias(c) for c in carry))
