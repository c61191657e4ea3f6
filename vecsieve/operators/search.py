"""Exact search: rank all database vectors for every query.

``against`` deals the queries into blocks of bounded size. Each block meets the whole
database in one task, which keeps it in an unnamed local file, scores some queries at a
time and hands one query's scores after the other to a visitor; what leaves the task is
what the visitor makes of them (ranks, the k best, metrics), so no pair of a query and a
row is shuffled. Ties go to the smaller id. ``scores`` gives the pairs themselves. Rows
whose vector is null or holds a null take no part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles

SMALL = 1 << 22
WIDE = Context(prec=400)
# queries from which on the rows they go to are dealt anew
DEALT = 64
CELLS = 1 << 22
# values of a block of queries, of a database kept in memory, and scores at a time
QUERY_VALUES, HELD_VALUES, HELD_SCORES = 1 << 22, 1 << 23, 1 << 22
TILE = 16
# tied scores that are looked up one by one
FEW_TIES = 16
NONE = np.iinfo(np.int64).min


def whole(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows whose vector is there and has no null."""
    return rows.filter(F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull()))


def dense(column: pa.Array | pa.ListScalar) -> np.ndarray:
    """Vectors of equal width as a matrix; none of them is null."""
    n = len(column)
    flat = (column.flatten() if isinstance(column, pa.Array) else column.values.flatten()).to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(n, -1) if n else np.zeros((0, 1))


def slabs(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose product with the columns stays below CELLS."""
    step = max(1, CELLS // max(1, columns))
    return (slice(i, i + step) for i in range(0, rows, step))


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """``F.round`` of the values, half up by their decimals, as they are without ``digits``."""
    if digits is None:
        return x
    if len(x) > 1 << 16:
        out = np.empty(len(x))
        for i in range(0, len(x), 1 << 16):
            out[i : i + (1 << 16)] = rounded(x[i : i + (1 << 16)], digits)
        return out
    scale = 10.0**digits
    y = np.abs(x) * scale
    down = np.floor(y)
    with np.errstate(invalid="ignore"):
        rest = y - down
    out = np.copysign(down + (rest >= 0.5), x) / scale + 0.0
    # where the product may stand on the other side of the half, or is too large
    for i in np.flatnonzero(~((np.abs(rest - 0.5) > 1e-6) & (y < 1 << 30))):
        exact = Decimal(repr(float(x[i])))
        out[i] = float(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, WIDE)) + 0.0 if exact.is_finite() else x[i]
    return out


def _emit(queries: np.ndarray, a: np.ndarray, items: np.ndarray, b: np.ndarray, k: int | None, digits: int | None) -> Iterator[pa.RecordBatch]:
    for part in slabs(len(queries), len(items)):
        s = a[part] @ b.T
        if k is None or k >= len(items):
            columns = [np.repeat(queries[part], len(items)), np.tile(items, len(s)), s.ravel()]
        else:
            edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(s >= edge[:, None])
            columns = [queries[part][row], items[col], s[row, col]]
        columns[2] = rounded(columns[2], digits)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "image_id", "sim"])


SCORES = "query_id long, image_id long, sim double"


def _beside(ids: np.ndarray, vectors: np.ndarray, k: int | None, digits: int | None):
    def run(batches):
        for batch in batches:
            if len(batch) and len(ids):
                yield from _emit(ids, vectors, batch["id"].to_numpy(), dense(batch["vec"]), k, digits)

    return run


def _between(k: int | None, digits: int | None):
    def run(batches):
        for batch in batches:
            for q, d in zip(batch["q_rows"], batch["d_rows"]):
                (queries, a), (items, b) = ((x.values.field("id").to_numpy(), dense(x.values.field("vec"))) for x in (q, d))
                yield from _emit(queries, a, items, b, k, digits)

    return run


def blocks(rows: DataFrame, count: int, size: int, name: str) -> tuple[DataFrame, int]:
    number = 1 + count // size
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(number)))
    return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "vec")).alias(f"{name}_rows")), number


def scores(queries: DataFrame, database: DataFrame, k: int | None = None, block: int = 4096, query_block: int = 4096, small: int = SMALL, digits: int | None = None) -> DataFrame:
    """``(query_id, image_id, sim)`` for ``(id, vec)`` rows of equal width. Few queries go to the rows, which are dealt over all cores however few files they come from. ``digits`` rounds the scores where they are made."""
    flat = lambda df: whole(df.select(F.col("id").cast("long").alias("id"), doubles(F.col("vec")).alias("vec")))
    q, d = flat(queries), flat(database)
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("w")).first()
    if size["n"] * size["w"] <= small:
        held = q.toArrow().combine_chunks()
        ids = held["id"].to_numpy()
        vectors = dense(held["vec"].combine_chunks()) if len(ids) else np.zeros((0, 1))
        if len(ids) > DEALT:
            d = d.repartition(2 * d.sparkSession.sparkContext.defaultParallelism, "id")
        return d.mapInArrow(_beside(ids, vectors, k, digits), SCORES)
    d, number = blocks(d, d.count(), block, "d")
    q, _ = blocks(q, size["n"], query_block, "q")
    q = q.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))))
    return q.join(d.hint("merge"), "d").select("q_rows", "d_rows").mapInArrow(_between(k, digits), SCORES)


def pairs(queries: DataFrame, database: DataFrame, block: int = 65536) -> DataFrame:
    """``(query_id, image_id)``: every id of the stated queries with every id of the database, by an equi-join on blocks of the latter."""
    number = 1 + database.count() // block
    d = database.select(F.col("id").alias("image_id"), F.pmod(F.xxhash64("id"), F.lit(number)).alias("_b"))
    q = queries.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))).alias("_b"))
    return q.join(d, "_b").drop("_b")


def descending(s: np.ndarray) -> np.ndarray:
    """Places from the highest score to the lowest, ties in their order; NaN is highest."""
    order = np.argsort(-s)
    line = s[order]
    nan = int(np.isnan(line).sum())
    tied = line[1:] == line[:-1]
    if tied.any() or nan > 1:
        tied[len(s) - nan :] = True
        group = np.zeros(len(s), np.int64)
        np.cumsum(~tied, out=group[1:])
        group *= len(s)
        group += order
        group.sort()
        order = group % len(s)
    return np.roll(order, nan) if nan else order


def best(s: np.ndarray, k: int) -> np.ndarray:
    """The first k of ``descending``."""
    if k >= len(s) or np.isnan(s).any():
        return descending(s)[:k]
    at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    return at[descending(s[at])][:k]


def in_order(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the scores at ``at`` as by ``descending``, and their ranks in it, from 0 and among all; all are put in order only if many of them are tied."""
    line = np.sort(s)
    up = np.argsort(s[at])
    values = s[at][up]
    end = np.searchsorted(line, values, "right")
    tied = values[(end > 1) & (line[end - 2] == values)] if len(at) else values
    if len(at) and np.isnan(line[-1]) or len(tied := np.unique(tied)) > FEW_TIES:
        rank = np.empty(len(s), np.int64)
        rank[descending(s)] = np.arange(len(s))
        order = np.argsort(rank[at])
        return order, rank[at][order]
    if not len(tied):
        return up[::-1], (len(s) - end)[::-1]
    rank = np.empty(len(s), np.int64)
    rank[at[up]] = len(s) - end
    for value in tied:
        rank[np.flatnonzero(s == value)] = len(s) - np.searchsorted(line, value, "right") + np.arange((s == value).sum())
    order = np.argsort(rank[at])
    return order, rank[at][order]


def places(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the scores at ``at``, as by ``descending``."""
    order, rank = in_order(s, at)
    out = np.empty(len(at), np.int64)
    out[order] = rank
    return out


def _tiled(rows: int) -> int:
    return -(-rows // TILE) * TILE


def products(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Inner products of the rows of a with those of b, which fill whole tiles: equal rows then have equal products wherever they stand. ``out`` has room for them."""
    if len(a) % TILE:
        a = np.concatenate([a, np.zeros((_tiled(len(a)) - len(a), a.shape[1]))])
    return np.matmul(a, b.T, out=None if out is None else out[: len(a)])


def _gathered(batches: Iterable[pa.RecordBatch]) -> tuple:
    """Queries and database of a task, ``(ids, marks, vectors, absent ids, absent marks)`` each, by id; vectors of the database fill whole tiles, in a file without a name if they are many."""
    sides = {True: ([], [], [], [], []), False: ([], [], [], [], [])}
    with tempfile.TemporaryFile() as file:
        width = 0
        for batch in batches:
            asked, there = (x.to_numpy(zero_copy_only=False) for x in (batch["_q"], batch["vec"].is_valid()))
            ids, marks = batch["id"].to_numpy(), batch["mark"].fill_null(int(NONE)).to_numpy()
            for side, (i, m, v, ai, am) in sides.items():
                own, away = (asked == side) & there, (asked == side) & ~there
                i.append(ids[own]), m.append(marks[own]), ai.append(ids[away]), am.append(marks[away])
                if own.any():
                    x = dense(batch["vec"].filter(pa.array(own)))
                    v.append(x) if side else file.write(np.ascontiguousarray(x).data)
                    width = x.shape[1]
        file.flush()
        join = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
        (qi, qm, qai, qam), (di, dm, dai, dam) = ([join(x[n]) for n in (0, 1, 3, 4)] for x in sides.values())
        q = np.concatenate([np.zeros((0, width)), *sides[True][2]])
        first, order = np.argsort(qi, kind="stable"), np.argsort(di, kind="stable")
        shape = (_tiled(len(di)), width)
        if len(di) * width <= HELD_VALUES:
            d = np.zeros(shape)
        else:
            with tempfile.TemporaryFile() as sorted_file:
                d = np.memmap(sorted_file, float, "w+", shape=shape)
        if len(di):
            raw = np.memmap(file, float, "r", shape=(len(di), width))
            for at in range(0, len(di), 4096):
                d[at : min(at + 4096, len(di))] = raw[order[at : at + 4096]]
    return (qi[first], qm[first], q[first], qai, qam), (di[order], dm[order], np.asarray(d), dai, dam)


def together(rows: Iterable[tuple | None], names: list[str], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of columns that come in pieces."""
    held, n = [], 0
    for row in rows:
        if row is not None and len(row[0]):
            held.append(row)
            n += len(row[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _visits(make: Callable, names: list[str]):
    def rows(batches):
        (qi, qm, q, qai, qam), (ids, marks, d, *absent) = _gathered(batches)
        visit = make(ids, marks, *absent)
        for i, m in zip(qai, qam):
            if not (qi == i).any():
                yield visit(i, m, None)
        same, step = [], max(TILE, min(_tiled(-(-HELD_SCORES // max(1, len(d)))), _tiled(len(q))))
        room = np.empty((step, len(d)))
        for start in range(0, len(q), step):
            same = [x.copy() for x in same]
            s = products(q[start : start + step], d, room)[:, : len(ids)]
            for n in range(start, min(start + step, len(q))):
                same.append(s[n - start])
                if n + 1 < len(q) and qi[n + 1] == qi[n]:
                    continue
                # rows that repeat a query's id have one ranking
                one = visit if len(same) == 1 else make(np.repeat(ids, len(same)), np.repeat(marks, len(same)), *absent)
                yield one(qi[n], qm[n], same[0] if len(same) == 1 else np.stack(same).T.ravel())
                same = []

    return lambda batches: together(rows(batches), names)


def against(queries: DataFrame, database: DataFrame, make: Callable, schema: str, mark: str | None = None) -> DataFrame:
    """What a visitor makes of each query and the whole database; rows are ``(id, vec)`` and a whole number named by ``mark``, vectors of equal width.

    ``make(ids, marks, absent ids, absent marks)`` gets the database, sorted by id; the absent have no
    whole vector. It returns ``visit(id, mark, sims)``, which returns columns of ``schema``, or None, and
    keeps no view of ``sims``, which is None for a query without a whole vector. A null mark is NONE; null ids go.
    """
    vec = doubles(F.col("vec"))
    fine = F.coalesce(F.forall(vec, lambda x: x.isNotNull()), F.lit(False))
    value = F.lit(None).cast("long") if mark is None else F.col(mark).cast("long")
    flat = lambda df: df.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.when(fine, vec).alias("vec"), value.alias("mark"))
    q, d = flat(queries), flat(database)
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("w")).first()
    blocks = -(-size["n"] * max(1, size["w"]) // QUERY_VALUES)
    number = max(1, blocks, min(2 * q.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // 64)))
    q = q.select(F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("_p"), F.lit(True).alias("_q"), "*")
    d = d.select(F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("_p"), F.lit(False).alias("_q"), "*")
    names = [x.split()[0] for x in schema.split(",")]
    return q.unionByName(d).repartitionById(number, "_p").drop("_p").mapInArrow(_visits(make, names), schema)


def rank(queries: DataFrame, database: DataFrame, k: int | None = None) -> DataFrame:
    """``(query_id, image_id, sim, rank)`` from rank 0; every database row, or the k best."""

    def make(ids, *_):
        def visit(q, _, s):
            if s is not None:
                order = descending(s) if k is None else best(s, k)
                return np.full(len(order), q), ids[order], s[order], np.arange(len(order))

        return visit

    return against(queries, database, make, "query_id long, image_id long, sim double, rank long")


def nearest_words(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1)
    parts = [np.argmin(half - 2 * (x[part] @ centers.T), axis=1) for part in slabs(len(x), len(centers))]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)


def nearest(points: DataFrame, centers: np.ndarray, vec: str = "vec", out: str = "word") -> DataFrame:
    """The index of the nearest centre, ties to the lowest; points without a whole vector go. ``centers`` is a model: its size is k times d."""
    names = points.columns

    def run(batches):
        for batch in batches:
            if len(batch):
                word = nearest_words(dense(batch[vec]), centers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word)], [*names, out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return whole(points, vec).mapInArrow(run, f"{schema}, {out} int")
