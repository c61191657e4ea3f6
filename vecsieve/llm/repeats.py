"""Windows that occur more than once in a corpus: distributed dealing of suffixes.

1. Every window belongs to its anchor, the leftmost least gram inside it. Neighbouring
   windows with one anchor form a context of bounded length.
2. Equal contexts are merged, with their number and first occurrence. An anchor with one
   context in all proves its windows unique.
3. The distinct contexts of an anchor are compared, window by window, by the operator's own
   index, each with its number of occurrences.
4. An anchor with more than ``group_limit`` distinct contexts would fill a task. Its windows
   go through digit passes over the cluster, from the most significant digit: groups of one
   drop out, those left after the last digit are the repeated windows.
5. What is found of a context holds at each of its occurrences.

Only anchors move through the counting shuffles; texts move once. Keys that hold more than
a thousandth of the rows of a join, at most a thousand, are joined where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import Cuts

ANCHOR = "h long, c long, uid long, p int, w int"
PIECE = "h long, c long, n long, uid long, p int, w int, body binary"
RANGES = "array<struct<a:int,k:int,own:boolean>>"
FOUND = f"h long, c long, n long, uid long, p int, ranges {RANGES}"
DIGITS = 4
BESIDE = 200_000  # rows of some 40 bytes


@dataclass(frozen=True)
class Windows:
    """``words``: symbols are words, else bytes. ``keep_first``: the earliest occurrence of a window stays."""

    words: bool
    length: int
    gram: int
    keep_first: bool
    group_limit: int = 4000
    bucket_rows: int = 1000


def bodies(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def symbols(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbol codes of texts and the bounds of each."""
    if words:
        found = A.Words(texts)
        return found.hashes(), found.first
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return A.BYTE_CODE[np.frombuffer(b"".join(texts), np.uint8)], np.concatenate([[0], np.cumsum(lengths)])


def short_words(text: bytes) -> list[bytes]:
    """Words of a text; of those longer than 64 bytes the fingerprint, so that no piece grows with them."""
    return [x if len(x) <= 64 else b"\0%016x" % A.Words([x]).hashes()[0] for x in text.split()]


def _anchor_rows(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            rows = list(zip(batch["uid"].to_pylist(), bodies(batch["text"])))
            for part in A.chunks(rows):
                uids = np.array([r[0] for r in part], np.int64)
                codes, bounds = symbols([r[1] for r in part], spec.words)
                if len(part) > 1 or len(codes) <= A.SEGMENT:
                    cuts = [(0, codes, bounds)]
                else:
                    cuts = [(i, codes[i:j], np.array([0, j - i])) for i, j in A.segments(len(codes), spec.length)]
                for at, some, edges in cuts:
                    h, c, d, p, w = A.anchors(some, edges, spec.length, spec.gram)
                    if len(h):
                        columns = [h.view(np.int64), c.view(np.int64), uids[d], (p + at).astype(np.int32), w.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "uid", "p", "w"])

    return run


def _piece_rows(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    extra = spec.length - 1

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for uid, text, wants in zip(batch["uid"].to_pylist(), bodies(batch["text"]), batch["wants"].to_pylist()):
                source = short_words(text) if spec.words else text
                for x in wants:
                    body = source[x["p"] : x["p"] + x["w"] + extra]
                    for column, v in zip(out, (x["h"], x["c"], x["n"], uid, x["p"], x["w"], b" ".join(body) if spec.words else body)):
                        column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["h", "c", "n", "uid", "p", "w", "body"])

    return run


def _window_rows(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window of a piece with its digits; the anchor is its first group."""
    step = -(-spec.length // DIGITS)

    def run(batches):
        for batch in batches:
            for h, n, uid, p, w, body in zip(*(batch[k].to_pylist() for k in ("h", "n", "uid", "p", "w", "body"))):
                roll = A.Rolling(symbols([body], spec.words)[0])
                at = np.arange(w)
                columns = [np.full(w, x, np.int64) for x in (h, n, uid, p)] + [at.astype(np.int32)]
                columns += [roll.of(at + min(d * step, spec.length), at + min((d + 1) * step, spec.length)).view(np.int64) for d in range(DIGITS)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["g", "n", "uid", "p", "i", *(f"d{d}" for d in range(DIGITS))])

    return run


def found_table(pieces: pa.Table, owner: np.ndarray, inside: np.ndarray, own: np.ndarray) -> pa.Table:
    """Pieces with windows ``inside`` them, sorted by piece and place, as lists of ranges ``(a, k, own)``."""
    if not len(owner):
        new, width = np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1) | (own[1:] != own[:-1])]))
        width = np.diff(np.concatenate([new, [len(owner)]]))
    which = owner[new]
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else new
    values = pa.StructArray.from_arrays([pa.array(inside[new], pa.int32()), pa.array(width, pa.int32()), pa.array(own[new], pa.bool_())], ["a", "k", "own"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(which)]]), pa.int32()), values)
    kept = pieces.select(["h", "c", "n", "uid", "p"]).take(pa.array(which[first], pa.int64()))
    return kept.append_column("ranges", lists)


def spread_join(cuts: Cuts, rows: DataFrame, keyed_rows: DataFrame, keys: list[str], count: str, parts: int = 1000) -> DataFrame:
    """Inner join with a table of unique ``keys``, of which ``count`` tells how many ``rows`` it has.

    Keys with more than a ``parts``-th of all, at most ``parts`` of them, are broadcast, and
    their rows go anywhere; the others meet by their hash.
    """
    table = cuts.cut(keyed_rows)
    cuts.drop()
    values = [c for c in table.columns if c not in keys]
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.filter(F.col(count) * parts > total + 1000 * parts)
    cold = table.filter(F.col(count) * parts <= total + 1000 * parts).select(*keys, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    marked = rows.join(F.broadcast(hot.select(*keys, F.struct(*values).alias("_hot"))), keys, "left")
    anywhere = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(1 << 20)) + 1
    dealt = marked.withColumn("_salt", F.when(F.col("_hot").isNotNull(), anywhere).otherwise(F.lit(0)).cast("long"))
    met = dealt.join(cold, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_cold")).filter("_got is not null")
    return met.select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in values])


def _digit_passes(cuts: Cuts, windows: DataFrame, pieces: DataFrame, keep_first: bool) -> DataFrame:
    """Windows of crowded ``pieces`` that repeat, by passes over their digits; ``FOUND`` rows."""
    rows, held = windows, []
    for d in range(DIGITS):
        after = cuts.cut(rows.withColumn("g", F.xxhash64("g", f"d{d}")).drop(f"d{d}"))
        cuts.drop(*held)
        rows, held = after, [after]
        place = F.struct("uid", (F.col("p") + F.col("i")).alias("at"))
        groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("times"), F.min(place).alias("first")).filter("times > 1")
        last = d == DIGITS - 1
        rows = spread_join(cuts, rows, groups if last else groups.select("g", "rows"), ["g"], "rows")
        rows = rows if last else rows.drop("rows")
    own = (F.col("first.uid") == F.col("uid")) & (F.col("first.at") == F.col("p") + F.col("i")) if keep_first else F.lit(False)
    rows = rows.withColumn("own", own).filter(~F.col("own") | (F.col("n") > 1))
    one = F.struct(F.col("i").alias("a"), F.lit(1).alias("k"), "own")
    ranges = cuts.cut(rows.groupBy("uid", F.col("p").cast("int").alias("p")).agg(F.collect_list(one).alias("ranges")))
    cuts.drop(*held)
    return pieces.join(ranges, ["uid", "p"]).select("h", "c", "n", "uid", "p", "ranges")


def repeated(cuts: Cuts, docs: DataFrame, spec: Windows, resolve: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``(uid, p, w)``: w windows from symbol p on that occur elsewhere (``keep_first``: earlier).

    ``resolve`` gets pieces, all of an anchor together, and returns ``FOUND`` rows for them.
    A range that is ``own`` is the window's first occurrence: it stays there.
    """
    every = docs.select("uid", "text").mapInArrow(_anchor_rows(spec), ANCHOR)  # made twice: as a table it takes most of the texts' size
    often = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = cuts.cut(spread_join(cuts, every, often, ["h"], "n").drop("n"))
    cuts.drop()
    first = F.min(F.struct("uid", "p", "w")).alias("first")
    kinds = cuts.cut(again.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), first).select("h", "c", "n", "first.*"))
    ship = cuts.cut(spread_join(cuts, kinds, kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")), ["h"], "kinds"))
    cuts.drop(kinds)
    texts = docs.select("uid", "text").filter("uid is not null")

    def pieces(rows: DataFrame, beside: bool) -> DataFrame:
        wants = rows.groupBy("uid").agg(F.collect_list(F.struct("h", "c", "n", "p", "w")).alias("wants"))
        return texts.join(F.broadcast(wants) if beside else wants, "uid").mapInArrow(_piece_rows(spec), PIECE)

    buckets = 1 + ship.count() // spec.bucket_rows
    crowd = ship.filter(F.col("kinds") > spec.group_limit)
    passed = None
    if crowded := crowd.count():
        digits = ", ".join(f"d{d} long" for d in range(DIGITS))
        # few of them go to the texts; more meet these by their hash
        windows = pieces(crowd, crowded <= BESIDE).mapInArrow(_window_rows(spec), f"g long, n long, uid long, p long, i int, {digits}")
        passed = _digit_passes(cuts, windows, crowd, spec.keep_first)
    light = cuts.cut(pieces(ship.filter(F.col("kinds") <= spec.group_limit), False))
    cuts.drop()
    found = light.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(resolve, FOUND)
    found = cuts.cut(found.unionByName(passed) if passed is not None else found)
    cuts.drop(ship, light)
    here = found.select("uid", "p", F.explode("ranges").alias("r"))
    here = here.filter("not r.own") if spec.keep_first else here
    others = found.filter("n > 1").select("h", "c", "n", F.col("uid").alias("uid0"), F.col("p").alias("p0"), "ranges")
    there = spread_join(cuts, again, others, ["h", "c"], "n").filter("uid != uid0 or p != p0").select("uid", "p", F.explode("ranges").alias("r"))
    ranges = cuts.cut(here.unionByName(there).select("uid", (F.col("p") + F.col("r.a")).alias("p"), F.col("r.k").alias("w")))
    cuts.drop(again, found)
    return ranges


def with_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the list of their ranges, null if none."""
    lists = found.groupBy("uid").agg(F.collect_list(F.struct("p", "w")).alias("ranges"))
    return docs.select("uid", "text").filter("uid is not null").join(lists, "uid", "left")
