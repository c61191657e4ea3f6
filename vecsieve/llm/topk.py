"""Exact top-k search by term-at-a-time accumulation.

Vectors are integer posting weights over terms (their dimensions). For each query row,
every non-zero term scatters its weighted postings into a dense array of scores, one
per candidate of a block; partition selection takes the block's best, and the blocks'
lists merge in a window. Query blocks go to where each candidate block is, which moves
once, over a sort-merge join on its number; both kinds of block have a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Packed blocks of about ``size`` rows, dealt by a hash of the id, and their number."""
    count = 1 + rows.count() // size
    one = F.struct("vec_id", "weights")
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "weights"), F.lit(count)))
    return dealt.groupBy(name).agg(F.collect_list(one).alias(f"{name}_rows")), count


def _dense(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    width = max((len(r["weights"]) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r["weights"])] = r["weights"]
    return ids, out


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _postings(column: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Candidates with a term and their weights; for a term that most have, no list, but the weights of all."""
    hit = np.flatnonzero(column)
    return (None, np.ascontiguousarray(column)) if 2 * len(hit) > len(column) else (hit, column[hit])


def _search(k: int):
    def run(batches):
        for batch in batches:
            for queries, candidates in zip(batch["q_rows"], batch["c_rows"]):
                qid, q = _dense(queries.as_py())
                cid, c = _dense(candidates.as_py())
                postings = [_postings(c[:, t]) for t in range(min(q.shape[1], c.shape[1]))]
                held = np.empty(len(cid), np.int64)
                out = [[], [], []]
                for row, own in zip(q, qid):
                    scores = np.zeros(len(cid), np.int64)
                    for t, weight in enumerate(row[: len(postings)].tolist()):
                        if weight:
                            hit, weights = postings[t]
                            if hit is None:
                                scores += np.multiply(weights, weight, out=held)
                            else:
                                scores[hit] += weight * weights
                    others = np.flatnonzero(cid != own)
                    best = others[select(scores[others], cid[others], k)]
                    for column, v in zip(out, (np.full(len(best), own), cid[best], scores[best])):
                        column.append(v)
                columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, query_block: int = 4096) -> DataFrame:
    """The k highest integer inner products of each query with all other vectors.

    Components become floor(scale * x), x as double. ``(query_id, rank from 1, vec_id,
    score)``, ties to the smaller id; all candidates if there are fewer than k. A vector
    that is null, has null or non-finite components, or has a null id takes no part; a
    missing component of a shorter vector, an empty one included, counts 0; candidates with
    the query's id are its own rows; equal candidate rows count once each; rows that repeat
    a query id give one list, of their best; empty tables give an empty result; other columns are not
    read. Sums are 64-bit.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
        ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
        return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("weights"))

    c, count = _blocks(whole(vectors), block, "c")
    q, _ = _blocks(whole(queries), query_block, "q")
    q = q.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    # partitions of stated number stay as they are, and a merge join keeps the copies of the queries from the driver
    q, c = (x.repartition(count, "c") for x in (q, c))
    near = q.join(c.hint("merge"), "c").select("q_rows", "c_rows").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
