"""Secret scans with a random forest against false positives.

Candidates are long tokens with a digit, values that stand after a key word and ``=`` or
``:``, and blocks of private keys. A forest on their length, character transitions,
dictionary coverage, path shape and neighbouring words, trained on labelled findings,
decides which are secrets. The dictionary, and the transitions of its letters, are counted
over all texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import bodies

Finding = tuple[bytes, bytes, bytes, int]
# Words whose presence near a token speaks for or against a secret.
FOR = (b"token", b"secret", b"passw", b"key", b"auth", b"bearer", b"credential", b"private", b"pwd", b"login")
AGAINST = (b"sha", b"commit", b"checksum", b"md5", b"uuid", b"example", b"hash", b"digest", b"order", b"phone", b"card", b"isbn", b"version", b"placeholder", b"account")
LONG = re.compile(rb"[A-Za-z0-9+/=_\-]{16,}")
BLOCK = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?-----END [A-Z ]{0,40}PRIVATE KEY-----", re.S)
_NAMED = re.compile(rb"[A-Za-z_\-]{0,24}(?:[\"']?[ \t]*[:=][ \t]*(?:[Bb]earer[ \t]+)?(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"',;]{6,}))|[ \t]+((?=\S{0,64}[0-9])(?=\S{0,64}[A-Za-z])[^\s\"',;]{8,}))")
NEAR = 32
_AROUND = re.compile(r"^[\W\d_]+|[\W\d_]+$")


class Dictionary:
    """Words of a corpus, commonest first, and the log-probabilities of one letter after another in them."""

    def __init__(self, counts: dict[str, int]):
        self.words = sorted(counts, key=lambda w: (-counts[w], w))
        self.known = frozenset(self.words)
        self.longest = max(map(len, self.words), default=0)
        pairs = np.ones((27, 27))
        for word in self.words:
            at = [0, *(ord(c) - 96 if "a" <= c <= "z" else 0 for c in word), 0]
            np.add.at(pairs, (at[:-1], at[1:]), 1)
        self.logp = np.log(pairs / pairs.sum(1, keepdims=True))

    def covered(self, run: str) -> int:
        """Most letters of a run that words side by side cover."""
        best = [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            best[end] = best[end - 1]
            for n in range(3, min(self.longest, end) + 1):
                if run[end - n : end] in self.known:
                    best[end] = max(best[end], best[end - n] + n)
        return best[-1]

    def fluency(self, runs: list[str]) -> float:
        """Mean log-probability of the runs' letters."""
        total, n = 0.0, 0
        for run in runs:
            at = np.array([0, *(ord(c) - 96 if "a" <= c <= "z" else 0 for c in run), 0])
            total, n = total + float(self.logp[at[:-1], at[1:]].sum()), n + len(run) + 1
        return total / n if n else -6.0


def _word_rows(batches):
    held: Counter = Counter()

    def flush():
        told: Counter = Counter()
        for word, n in held.items():
            bare = word if word.isalpha() else _AROUND.sub("", word)
            if 3 <= len(bare) <= 20 and bare.isalpha():
                told[bare] += n
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(told), pa.string()), pa.array(list(told.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch["text"].to_pylist():
            held.update((text or "").lower().split())
            if len(held) > 1 << 17:
                yield flush()
    yield flush()


def dictionary(docs: DataFrame, text_col: str = "text", most: int = 20000, least: int = 3) -> Dictionary:
    """Counted over all texts: the ``most`` commonest words of 3 to 20 letters that occur ``least`` times."""
    words = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_word_rows, "word string, n long")
    counts = words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = counts.orderBy(F.col("n").desc(), "word").limit(most).toArrow()
    return Dictionary(dict(zip(found["word"].to_pylist(), found["n"].to_pylist())))


def describe(token: bytes, before: bytes, after: bytes, known: Dictionary) -> list[float]:
    """Features of a candidate and of what stands next to it."""
    block = token.startswith(b"-----BEGIN ")
    t = token.decode("utf-8", "replace")
    n = len(t)
    kinds = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in t])
    share = np.bincount(kinds, minlength=4) / n
    counts = np.unique(list(t), return_counts=True)[1] / n
    low = t.lower()
    b, a = before.lower(), after.lower()
    runs = re.findall(r"[^\W\d_]+", low) if not block else []
    letters = sum(map(len, runs))
    vowels = sum(c in "aeiou" for run in runs for c in run) / max(1, letters)
    tail = b.rstrip(b" \t\"'`")
    return [
        float(n), *share.tolist(), float(-(counts * np.log2(counts)).sum()), float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        sum(map(known.covered, runs)) / n, known.fluency(runs), vowels, float(max(map(len, runs), default=0)),
        float(bool(re.fullmatch(r"[0-9a-f]+", low))), float(low.count("/") + low.count("-")),
        float(b[-1:] in b"/.\\?&#" and bool(b)), float(any(w in b for w in FOR)), float(any(w in b or w in a for w in AGAINST)),
        float(tail[-1:] in (b"=", b":")), float(b[-1:] in (b"\"", b"'")), float(len(set(low)) / n), float(" " in t), float(block),
    ]


def labelled_findings(words: Sequence[str], count: int = 2000, seed: int = 11) -> list[Finding]:
    """Findings ``(token, before, after, label)`` drawn from formats of keys and of what is taken for keys; prose is made of ``words``."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    hexa, lower, upper, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    both = lower + upper + digits
    words = list(words)[:2000] or ["the", "river", "stone", "other", "station", "window", "garden", "letter"]
    word = lambda: str(rng.choice(words))
    assign = ["token = \"", "api_key: ", "secret=", "password = '", "Authorization: Bearer ", "key=\"", "TOKEN = \"", "auth_token: \"", "private_key = ", "pwd: "]
    out = []
    for i in range(count):
        keyed = str(rng.choice(assign))
        body = [
            lambda: pick(hexa, 40), lambda: pick(hexa, 32), lambda: pick(both, 40), lambda: "AKIA" + pick(upper + digits, 16), lambda: "ghp_" + pick(both, 36), lambda: "sk-" + pick(both, 32),
            lambda: pick(both + "+/", 43) + "=", lambda: pick(hexa, 64), lambda: word()[:8] + str(rng.integers(0, 99)) + pick("!@#%&?", 1), lambda: pick(both + "!#%&?@", int(rng.integers(8, 15))),
            lambda: pick(lower, int(rng.integers(18, 33))), lambda: "xoxb-" + pick(digits, 4) + "-" + pick(both, 8),
        ][i % 12]()
        bare = i % 12 in (3, 4, 5, 11) and rng.random() < 0.4
        lead = f"{word()} {word()} " + ("" if bare else keyed)
        if lead.endswith("TOKEN = \"") and i % 12 < 8:
            body = body.upper()
        quote = lead[-1:] if lead[-1:] in "\"'" else ""
        if i % 40 == 39:
            body, lead, quote = f"-----BEGIN RSA PRIVATE KEY-----\n{pick(both, 64)}\n-----END RSA PRIVATE KEY-----", f"{word()} ", ""
        out.append((body, lead, f"{quote} {word()}", 1))
        kind = i % 12
        lead, tail = f"{word()} {word()} ", f" {word()}"
        if kind == 0:
            body, lead = pick(hexa, 40), lead + "commit "
        elif kind == 1:
            body = "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12))
            lead += rng.choice(["", "uuid: ", "id "])
        elif kind == 2:
            body = pick(digits, int(rng.integers(16, 20)))
            lead += rng.choice(["", "", "card ", "order "])
        elif kind == 3:
            body, lead = pick(hexa, 64), lead + rng.choice(["sha256:", "checksum "])
        elif kind == 4:
            body = "-".join(word() for _ in range(4)) + f"-{rng.integers(1, 2030)}"
            lead += "https://www.site.com/"
        elif kind == 5:
            body = f"{word()}_{word()}_{word()}{rng.integers(0, 99)}"
        elif kind == 6:
            body, lead = "EXAMPLE" + "X" * 12 + "0", lead + "key="
        elif kind == 7:
            body = "/".join(word() for _ in range(3)) + f"/v{rng.integers(0, 99)}"
            lead += "/"
        elif kind == 8:
            body = word().title() + word().title() + word().title() + str(rng.integers(0, 999))
        elif kind == 9:
            body, lead = str(rng.choice([word() + ".", word() + word(), word().title()])), lead + str(rng.choice(assign))
        elif kind == 10:
            body, lead = f"{word()} {word()} {word()}", lead + str(rng.choice(["secret: \"", "key = '", "password: \"", "login: '"]))
            tail = lead[-1] + tail
        else:
            body, lead = word() + " "[:0], lead + str(rng.choice(["key: ", "secret: ", "login: ", "token: "]))
        out.append((body, lead, tail, 0))
    return [(a.encode(), b.encode()[-NEAR:], c.encode()[:NEAR], y) for a, b, c, y in out]


class Forest:
    """Random forest of axis-parallel trees, grown on bootstrap samples with random feature subsets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            at = rng.integers(0, len(y), len(y))
            nodes: list[tuple] = []
            self._grow(x[at], y[at], depth, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))

    def _grow(self, x, y, depth, rng, nodes) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth == 0 or len(y) < 6 or y.min() == y.max():
            return me
        best = (math.inf, 0, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            for cut in np.unique(np.quantile(x[:, f], (0.1, 0.3, 0.5, 0.7, 0.9))):
                left = x[:, f] <= cut
                n = left.sum()
                if 0 < n < len(y):
                    p, q = y[left].mean(), y[~left].mean()
                    best = min(best, (n * p * (1 - p) + (len(y) - n) * q * (1 - q), int(f), float(cut)))
        if best[0] < math.inf:
            left = x[:, best[1]] <= best[2]
            a = self._grow(x[left], y[left], depth - 1, rng, nodes)
            b = self._grow(x[~left], y[~left], depth - 1, rng, nodes)
            nodes[me] = (best[1], best[2], a, b, float(y.mean()))
        return me

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, a, b, p in self.trees:
            at = np.zeros(len(x), np.int64)
            while (f[at] >= 0).any():
                inner = f[at] >= 0
                right = x[np.arange(len(x)), np.maximum(f[at], 0)] > cut[at]
                at = np.where(inner, np.where(right, b[at], a[at]), at)
            total += p[at]
        return total / len(self.trees)


def split_findings(findings: list[Finding], share: int = 4) -> tuple[list[Finding], list[Finding]]:
    """Findings to learn from and findings held out, one in ``share`` by a hash of the finding."""
    part = [int(hashlib.sha256(b"\0".join(r[:3])).hexdigest()[:8], 16) % share == 0 for r in findings]
    return [r for r, held in zip(findings, part) if not held], [r for r, held in zip(findings, part) if held]


def train(findings: list[Finding], known: Dictionary, most: int = 10000) -> Forest:
    """A forest from at most ``most`` labelled findings, least by a hash."""
    chosen = sorted(findings, key=lambda r: hashlib.sha256(b"\0".join(r[:3])).digest())[:most]
    return Forest(np.array([describe(*r[:3], known) for r in chosen]), np.array([r[3] for r in chosen], float))


def quality(forest: Forest, known: Dictionary, findings: list[Finding], threshold: float = 0.5) -> tuple[float, float]:
    """Precision and recall on labelled findings."""
    said = forest(np.array([describe(*r[:3], known) for r in findings])) >= threshold
    true = np.array([r[3] == 1 for r in findings])
    return float((said & true).sum() / max(1, said.sum())), float((said & true).sum() / max(1, true.sum()))


def _named(text: bytes) -> list[tuple[int, int]]:
    """Values after a key word: quoted or not behind ``=`` or ``:``, with a digit and a letter behind a space."""
    low, out = text.lower(), []
    for word in FOR:
        at = low.find(word)
        while at >= 0:
            m = _NAMED.match(text, at + len(word))
            if m:
                out.append(m.span(m.lastindex))
            at = low.find(word, at + len(word))
    return out


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Spans of what may be a secret, in order; of those that overlap, the first and longest."""
    out = [m.span() for m in BLOCK.finditer(text)] if b"-----BEGIN " in text else []
    out += _named(text)
    out += [m.span() for m in LONG.finditer(text) if any(48 <= c <= 57 for c in m[0])]
    kept: list[tuple[int, int]] = []
    for s, e in sorted(out, key=lambda x: (x[0], -x[1])):
        if not kept or s >= kept[-1][1]:
            kept.append((s, e))
    return kept


OUT = "id long, n_candidates long, n_secrets long, findings array<struct<start:long,end:long,score:double>>, redacted string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: list[Finding] | None = None, threshold: float = 0.5, mask: str = "[SECRET]", carry: Sequence[str] = ()) -> DataFrame:
    """``(id, n_candidates, n_secrets, findings, redacted)`` per input row, and its columns ``carry``.

    ``findings``, labelled, teach the forest (10,000 at most); without any, they are drawn from
    known formats and the corpus' words. The result's ``findings`` has byte spans and scores of
    the secrets, ``redacted`` the text with each replaced by ``mask``. The dictionary holds the
    20,000 commonest words of all texts. A null text has no candidates and stays null; an
    empty one has none; repeated rows and null ids are scanned row by row; a text of any length
    is scanned whole; an empty table gives an empty result; other columns are not read.
    """
    known = dictionary(docs, text_col)
    forest = train(labelled_findings(known.words) if findings is None else findings, known)

    def run(batches):
        for batch in batches:
            texts, nulls = bodies(batch["text"]), batch["text"].is_null().to_pylist()
            spans = [candidates(t) for t in texts]
            rows = [describe(t[s:e], t[max(0, s - NEAR) : s], t[e : e + NEAR], known) for t, found in zip(texts, spans) for s, e in found]
            scores = forest(np.array(rows)).tolist() if rows else []
            out, k = [[], [], [], [], []], 0
            for row, text, found, null in zip(batch["id"].to_pylist(), texts, spans, nulls):
                own = [(s, e, p) for (s, e), p in zip(found, scores[k : k + len(found)]) if p >= threshold]
                k += len(found)
                parts, at = [], 0
                for s, e, _ in own:
                    parts += [text[at:s], mask.encode()]
                    at = e
                clean = None if null else b"".join([*parts, text[at:]]).decode("utf-8", "replace")
                hits = [{"start": s, "end": e, "score": p} for s, e, p in own]
                for column, v in zip(out, (row, len(found), len(own), hits, clean)):
                    column.append(v)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            types = (pa.int64(), pa.int64(), pa.int64(), kind, pa.string())
            names = ["id", "n_candidates", "n_secrets", "findings", "redacted", *carry]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, types)), *(batch[c] for c in carry)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]
    return rows.mapInArrow(run, ", ".join([OUT, *kinds])).withColumnRenamed("id", id_col)
