"""Conflict-constrained best-fit packing.

Shards of documents are packed on their own. Bins stand by residual, and within a
residual by the bitmaps of the sources and duplicate clusters that they hold; the
search starts at the least residual that fits and goes on to the tightest compatible
bin, testing a bitmap once for all bins that share it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count

OUT = "row long, piece int, n_words long, shard long, bin int, start long"


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.residuals = 0
        self.count = 0

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and start for an item; the bitmaps have the bits that no other item of its bin may have."""
        left = self.residuals >> size
        residual = size - 1
        while left:
            step = (left & -left).bit_length()
            residual, left = residual + step, left >> step
            groups = self.open[residual]
            for key, bins in groups.items():
                if not (key[0] & source or key[1] & cluster):
                    number = bins.pop()
                    if not bins:
                        del groups[key]
                        if not groups:
                            del self.open[residual]
                            self.residuals &= ~(1 << residual)
                    self._keep(number, residual - size, (key[0] | source, key[1] | cluster))
                    return number, self.capacity - residual
        number = self.count
        self.count += 1
        self._keep(number, self.capacity - size, (source, cluster))
        return number, 0

    def _keep(self, number: int, residual: int, key: tuple[int, int]) -> None:
        if residual:
            self.open.setdefault(residual, {}).setdefault(key, []).append(number)
            self.residuals |= 1 << residual


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[k].to_pylist() for k in ("row", "n_words", "source_key", "cluster", "shard"))), key=lambda r: (-(r[1] % capacity), r[0] is None, -(r[0] or 0)))
        named: tuple[dict, dict] = ({}, {})
        bit = lambda kind, v: 0 if v is None else 1 << named[kind].setdefault(v, len(named[kind]))
        seen: dict = {}
        for r in rows:
            seen[r[3]] = seen.get(r[3], 0) + 1
        bins, full = Bins(capacity), []
        out = []
        for row, n, source, cluster, shard in rows:
            rest = n % capacity
            full += [(row, i, capacity, shard) for i in range(n // capacity)]
            if rest:
                number, start = bins.put(rest, bit(0, source), bit(1, cluster) if seen[cluster] > 1 else 0)
                out.append((row, n // capacity, rest, shard, number, start))
        out += [(row, i, n, shard, bins.count + k, 0) for k, (row, i, n, shard) in enumerate(full)]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(x, t) for x, t in zip(columns, types)], [x.split()[0] for x in OUT.split(", ")])

    return run


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = 1024, shard_docs: int = 2000) -> DataFrame:
    """Pieces of documents in bins of ``capacity`` words.

    ``(id, piece, n_words, shard, bin, start)``: a document longer than a bin fills whole
    bins first; its rest shares a bin with rests of other sources and other duplicate
    clusters only. ``cluster_col`` names the clusters; without it, equal lower-cased texts
    are one. A null source or cluster conflicts with nothing. Items
    of one size go in by descending id, null ids last; an item takes the tightest bin that fits,
    among equals one that no smaller test finds in conflict. Documents without words, null
    texts included, give no piece; rows that repeat an id are documents of their own, and a
    cluster if their texts are equal; an empty table gives an empty result; columns of clashing names are not
    read. Bins are numbered from 0 in each shard; shards are dealt by a hash of id and text.
    """
    cluster = F.col(cluster_col) if cluster_col else F.lower(text_col)
    base = docs.select(
        F.col(id_col).cast("long").alias("row"), word_count(F.col(text_col)).alias("n_words"),
        F.xxhash64(source_col).alias("_s"), F.col(source_col).isNull().alias("_none"),
        F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster"), F.xxhash64(id_col, text_col).alias("_deal"),
    )
    shards = 1 + docs.count() // shard_docs
    base = base.filter("n_words > 0").select("row", "n_words", F.when(~F.col("_none"), F.col("_s")).alias("source_key"), "cluster", F.pmod("_deal", F.lit(shards)).alias("shard"))
    return base.groupBy("shard").applyInArrow(_pack(capacity), OUT).withColumnRenamed("row", id_col)
