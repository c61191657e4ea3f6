"""Suffix-array deduplication of exact byte substrings.

The suffix order needs only the first ``threshold`` bytes of each suffix: a radix sort
from the most significant digit refines groups of equal suffixes and drops those of
one; the groups left after the last digit are exactly the repeated windows. The first
digit, an anchor gram, deals the groups out over the cluster (``repeats``); the other
digits are sorted inside a task, or over the cluster where an anchor has too many contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .repeats import Windows, bodies, found_table, repeated, with_ranges
from .store import Cuts, keyed, restore_id

OUT = "uid long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"


def radix_groups(group: np.ndarray, suffix: np.ndarray, times: np.ndarray, body: np.ndarray, threshold: int, digit: int) -> np.ndarray:
    """Indices of suffixes whose first ``threshold`` bytes recur within their group; suffix i stands for ``times[i]``."""
    roll = A.Rolling(A.BYTE_CODE[body])
    alive, rank = np.arange(len(suffix)), group
    for at in range(0, threshold, digit):
        start = suffix[alive] + at
        value = roll.of(start, start + min(digit, threshold - at))
        order = np.lexsort((value, rank))
        r, v = rank[order], value[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]) if len(r) else np.zeros(0, bool)
        label = np.cumsum(new) - 1
        shared = np.bincount(label, times[alive[order]])[label] > 1 if len(label) else new
        alive, rank = alive[order][shared], label[shared]
    return np.sort(alive)


def _resolver(threshold: int, digit: int):
    def resolve(table: pa.Table) -> pa.Table:
        w = table["w"].to_numpy().astype(np.int64)
        parts = table["body"].to_pylist()
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(w)), w)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
        group = np.unique(table["h"].to_numpy(), return_inverse=True)[1][owner]
        hit = radix_groups(group, start[owner] + inside, table["n"].to_numpy()[owner], np.frombuffer(b"".join(parts), np.uint8), threshold, digit)
        return found_table(table, owner[hit], inside[hit], np.zeros(len(hit), bool))

    return resolve


def _strip(threshold: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for uid, text, ranges in zip(batch["uid"].to_pylist(), bodies(batch["text"]), batch["ranges"].to_pylist()):
                at = np.array([(x["p"], x["w"]) for x in ranges or ()], np.int64).reshape(-1, 2)
                s, e = A.runs(at[:, 0], at[:, 1] + threshold - 1)
                edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
                spans = [{"start": i, "end": j} for i, j in zip(s.tolist(), e.tolist())]
                for column, v in zip(out, (uid, len(text), len(text) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest())):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
            names = ["uid", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return run


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 200, digit: int = 50) -> DataFrame:
    """Remove every byte that lies in a repeated window of ``threshold`` bytes.

    One row per input row: ``uid``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed
    runs), ``kept`` (remaining bytes), ``kept_sha256`` and the id under its own name. A null
    text is empty; texts shorter than the threshold stay whole; copies of a text, also under
    one id, all lose it; rows that repeat an id are documents of their own; an empty table
    gives an empty result; columns besides the id and the text are not read. ``threshold``
    is at least 2. Equality of windows is that of four 64-bit fingerprints of 50 bytes each.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    cuts = Cuts(docs.sparkSession)
    rows = keyed(cuts, docs, id_col, text_col)
    spec = Windows(words=False, length=threshold, gram=(threshold + 1) // 2, keep_first=False)
    found = repeated(cuts, rows, spec, _resolver(threshold, digit))
    out = with_ranges(rows, found).mapInArrow(_strip(threshold), OUT)
    return restore_id(cuts, out, rows, id_col)
