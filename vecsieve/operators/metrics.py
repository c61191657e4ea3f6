"""Retrieval metrics: protocols, average precision, precision at k.

Only graded items take part in the joins: an item's position once ignored items are gone
is its rank less the number of ignored items before it. Where a rule on ids and labels
grades the items (``Grades``), metrics are made where a query's scores are, by ``*_by``:
neither ranking nor truth become rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import NONE, against, best, in_order

# Role of each grade under each protocol.
ROLES = [
    ("easy", "easy", "positive"), ("easy", "hard", "ignored"), ("easy", "junk", "ignored"),
    ("medium", "easy", "positive"), ("medium", "hard", "positive"), ("medium", "junk", "ignored"),
    ("hard", "hard", "positive"), ("hard", "easy", "ignored"), ("hard", "junk", "ignored"),
]
PROTOCOLS = ["easy", "medium", "hard"]
GRADES = ["easy", "hard", "junk"]
# Of a query's id and of database ids with the query's label: 1 + place in GRADES.
Grades = Callable[[int, np.ndarray], np.ndarray]


def explode_truth(queries: DataFrame) -> DataFrame:
    """``(query_id, image_id, grade)`` from lists easy, hard and junk."""
    lists = F.explode(F.create_map(*[x for g in ("easy", "hard", "junk") for x in (F.lit(g), F.col(g))]))
    return queries.select("query_id", lists.alias("grade", "ids")).select("query_id", F.explode("ids").alias("image_id"), "grade")


def protocol_sets(truth: DataFrame, once: bool = False) -> DataFrame:
    """``(protocol, query_id, image_id, role)``; duplicates collapse, unless the truth is said to have none."""
    kinds = {g: F.array(*[F.struct(F.lit(p).alias("protocol"), F.lit(r).alias("role")) for p, of, r in ROLES if of == g]) for g in GRADES}
    of = reduce(lambda c, g: c.when(F.col("grade") == g, kinds[g]), GRADES, F)
    out = truth.select("query_id", "image_id", F.explode(of).alias("r")).select("r.protocol", "query_id", "image_id", "r.role")
    return out if once else out.distinct()


def graded(truth: DataFrame) -> DataFrame:
    """``(query_id, image_id, roles)``: one row per graded item; its role under each protocol that gives it one, ignored before positive."""
    flags = truth.groupBy("query_id", "image_id").agg(*[F.max((F.col("grade") == g).cast("int")).alias(g) for g in ("easy", "hard", "junk")])
    kinds = {}
    for protocol in PROTOCOLS:
        of = lambda role: [F.col(g) == 1 for p, g, r in ROLES if p == protocol and r == role]  # noqa: E731, B023
        ignored, positive = (reduce(Column.__or__, of(role)) for role in ("ignored", "positive"))
        kinds[protocol] = F.struct(F.lit(protocol).alias("protocol"), positive.alias("positive"), ignored.alias("ignored"))
    roles = F.filter(F.array(*kinds.values()), lambda r: r["positive"] | r["ignored"])
    return flags.select("query_id", "image_id", roles.alias("roles"))


def _placed(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """``(protocol, query_id, image_id, pos, j)`` of positives: place and ordinal once ignored items are gone."""
    seen = ranked.select("query_id", "image_id", "rank").join(items, ["query_id", "image_id"])
    one = seen.select("query_id", "image_id", "rank", F.explode("roles").alias("r")).select("query_id", "image_id", "rank", "r.*")
    order = Window.partitionBy("protocol", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gone, found = F.sum(F.col("ignored").cast("long")).over(order), F.sum((~F.col("ignored")).cast("long")).over(order)
    placed = one.withColumn("pos", F.col("rank") - gone).withColumn("j", found - 1)
    return placed.filter(~F.col("ignored")).select("protocol", "query_id", "image_id", "pos", "j")


def filtered_positions(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """``(protocol, query_id, image_id, pos)`` of positives once ignored items are dropped."""
    return _placed(ranked, graded(truth)).drop("j")


def query_metrics(ranked: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(protocol, query_id, n_positive, ap, precision)`` for every query and protocol; NaN without positives.

    A query whose positives are all missing from the ranking has AP and precision 0.
    """
    items = graded(truth)
    n = items.select("query_id", F.explode("roles").alias("r")).filter("r.positive").groupBy("query_id", F.col("r.protocol").alias("protocol")).agg(F.count(F.lit(1)).alias("n_positive"))
    last = F.least(F.max("pos").over(Window.partitionBy("protocol", "query_id")) + 1, F.lit(k))
    p0 = F.when(F.col("pos") == 0, 1.0).otherwise(F.col("j") / F.col("pos"))
    p1 = (F.col("j") + 1) / (F.col("pos") + 1)
    terms = _placed(ranked, items).withColumn("kq", last).withColumn("term", (p0 + p1) / 2)
    found = terms.groupBy("protocol", "query_id").agg(F.sum("term").alias("terms"), (F.sum((F.col("pos") < F.col("kq")).cast("int")) / F.max("kq")).alias("precision"))
    every = queries.select("query_id", F.explode(F.array(*map(F.lit, PROTOCOLS))).alias("protocol"))
    out = every.join(n, ["protocol", "query_id"], "left").join(found, ["protocol", "query_id"], "left")
    value = lambda c: F.when(F.col("n_positive").isNull(), float("nan")).otherwise(F.coalesce(c, F.lit(0.0)))
    return out.select(
        "protocol", "query_id", F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        value(F.col("terms") / F.col("n_positive")).alias("ap"), value(F.col("precision")).alias("precision"),
    )


def _kinds(role: str) -> np.ndarray:
    """Whether a protocol gives a grade the role; grade 0 has none."""
    return np.array([[False, *((p, g, role) in ROLES for g in GRADES)] for p in PROTOCOLS])


def _coder(grades: Grades, ids: np.ndarray, marks: np.ndarray) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """Places of the graded items for a query's id and label, and their grades. Items are put in order of labels once."""
    repeated = bool((ids[1:] == ids[:-1]).any())
    order = np.argsort(marks, kind="stable")
    line = marks[order]

    def code(q: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        at = order[np.searchsorted(line, own) : np.searchsorted(line, own, "right")] if own != NONE else order[:0]
        at = np.flatnonzero(np.isin(ids, ids[at])) if repeated else at
        codes = grades(q, ids[at])
        return (at, codes) if codes.all() else (at[codes > 0], codes[codes > 0])

    return code


def _placed_by(queries: DataFrame, database: DataFrame, grades: Grades, make_rows: Callable, schema: str) -> DataFrame:
    """Rows of ``make_rows(query, protocol, number of positives, ids, pos)`` of positives in their order once ignored items are gone."""
    positive, ignored = _kinds("positive"), _kinds("ignored")

    def make(ids, marks, away_ids, away_marks):
        code, away = _coder(grades, ids, marks), _coder(grades, away_ids, away_marks)
        single = not len(away_ids) and not (ids[1:] == ids[:-1]).any()

        def visit(q, own, s):
            (at, codes), (lost, lost_codes) = code(q, own), away(q, own)
            counts = np.bincount(codes, minlength=1 + len(GRADES))
            if s is not None:
                order, rank = in_order(s, at)
                items, kinds = ids[at[order]], codes.astype(np.int8)[order]
                of = [kinds == g for g in range(1 + len(GRADES))]
            rows = []
            for p in range(len(PROTOCOLS)):
                n = int(counts[positive[p]].sum()) if single else len(np.unique(np.concatenate([ids[at[positive[p][codes]]], away_ids[lost[positive[p][lost_codes]]]])))
                if s is None:
                    rows.append(make_rows(q, p, n, ids[:0], np.zeros(0, np.int64)))
                    continue
                gone, mine = (reduce(np.logical_or, (of[g] for g in np.flatnonzero(x[p])), of[0]) for x in (ignored, positive))
                mine = np.flatnonzero(mine)
                rows.append(make_rows(q, p, n, items[mine], rank[mine] - np.cumsum(gone)[mine]))
            return tuple(map(np.concatenate, zip(*rows)))

        return visit

    out = against(queries, database, make, "p int, " + schema, "label")
    return out.withColumn("p", F.element_at(F.array(*map(F.lit, PROTOCOLS)), F.col("p") + 1)).withColumnRenamed("p", "protocol")


def filtered_positions_by(queries: DataFrame, database: DataFrame, grades: Grades) -> DataFrame:
    """``filtered_positions`` of the exact ranking of ``(id, vec, label)`` rows."""

    def rows(q, p, _, ids, pos):
        return np.full(len(ids), p, np.int32), np.full(len(ids), q), ids, pos

    return _placed_by(queries, database, grades, rows, "query_id long, image_id long, pos long")


def query_metrics_by(queries: DataFrame, database: DataFrame, grades: Grades, k: int = 10) -> DataFrame:
    """``query_metrics`` of the exact ranking of ``(id, vec, label)`` rows."""

    def rows(q, p, n, _, pos):
        ap = precision = 0.0 if n else float("nan")
        if len(pos) and n:
            j, last = np.arange(len(pos)), min(pos[-1] + 1, k)
            before = np.divide(j, pos, out=np.ones(len(pos)), where=pos > 0)
            ap, precision = ((before + (j + 1) / (pos + 1)) / 2).sum() / n, (pos < last).sum() / last
        return np.array([p], np.int32), np.array([q]), np.array([n]), np.array([float(ap)]), np.array([float(precision)])

    return _placed_by(queries, database, grades, rows, "query_id long, n_positive long, ap double, precision double")


def result_status_by(queries: DataFrame, database: DataFrame, grades: Grades, protocol: str, k: int) -> DataFrame:
    """``result_status`` of the k best of the exact ranking of ``(id, vec, label)`` rows."""
    row = PROTOCOLS.index(protocol)
    role = np.where(_kinds("ignored")[row], 1, np.where(_kinds("positive")[row], 2, 3)).astype(np.int32)

    def make(ids, marks, *_):
        code = _coder(grades, ids, marks)

        def visit(q, own, s):
            if s is not None:
                at = best(s, k)
                codes = np.zeros(len(ids), np.int8)
                where, kinds = code(q, own)
                codes[where] = kinds
                return np.full(len(at), q), ids[at], np.arange(len(at)), role[codes[at]]

        return visit

    out = against(queries, database, make, "query_id long, image_id long, rank long, status int", "label")
    return out.withColumn("status", F.element_at(F.array(*map(F.lit, ("ignored", "correct", "wrong"))), F.col("status")))


def evaluate(per_query: DataFrame, k: int = 10) -> DataFrame:
    """Means per protocol over answerable queries; NaN if none is."""
    nan, ok = F.lit(float("nan")), F.col("n_positive") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), nan)
    return per_query.groupBy("protocol").agg(
        mean("ap").alias("map"), mean("precision").alias("mp_at_k"), F.lit(k).alias("k"),
        F.count(F.when(ok, 1)).alias("num_queries"), F.count(F.when(~ok, 1)).alias("num_excluded"),
    )


def typical_query(per_query: DataFrame, protocol: str) -> DataFrame:
    """The query whose AP is nearest to the mean, ties to the smaller id. The exchange of ``(query_id, ap)`` is read twice, so that APs are made once."""
    some = per_query.filter((F.col("protocol") == protocol) & (F.col("n_positive") > 0)).select("query_id", "ap").repartition("query_id")
    mean = some.agg(F.avg("ap").alias("mean"))
    gap = F.abs(F.col("ap") - F.col("mean"))
    return some.join(F.broadcast(mean)).orderBy(gap, "query_id").limit(1).select("query_id", "ap")


def result_status(ranked: DataFrame, truth: DataFrame, protocol: str) -> DataFrame:
    """Ranked items as correct, ignored or wrong."""
    sets = protocol_sets(truth).filter(F.col("protocol") == protocol).groupBy("query_id", "image_id").agg(F.min("role").alias("role"))
    status = F.when(F.col("role") == "ignored", "ignored").when(F.col("role") == "positive", "correct").otherwise("wrong")
    return ranked.join(sets, ["query_id", "image_id"], "left").select("query_id", "image_id", "rank", status.alias("status"))


def set_sizes(truth: DataFrame, bins: int = 15, top: int = 150) -> DataFrame:
    """Histogram of relevance-set sizes in equal bins."""
    sizes = truth.filter("grade != 'junk'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.least(F.floor(F.col("n") * bins / top), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("queries"))
