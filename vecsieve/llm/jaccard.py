"""Exact n-gram Jaccard join by a token-group matrix.

1. Copies of a text are represented by the first.
2. Tokens (shingle fingerprints) are counted over the corpus in packed blocks. A document of
   which fewer tokens recur than a partner must share can have none.
3. The tokens that recur stand in one order for all documents, rarest first by powers of
   two. Partners share one before the last ``need(n) - 1`` of either: only those before it,
   a document's prefix, look for partners. Passages that many documents quote fall out.
   Documents are partitioned into groups of similar ones: most of a member's votes, tokens
   of its prefix, have the group's leader as first holder.
4. The matrix of tokens and groups holds the union of each group's prefixes. A document's
   overlap with a group is at most its tokens after the prefix and those of the prefix that
   the union has: without one of these the bound is below the need, and no token set moves.
   A document visits the groups that qualify. There the bound on the whole union decides
   which are opened.
5. Large groups are split into rooms which share the group's first members, and many
   visitors into slices. Documents that the first members do not connect visit the rooms
   whose union meets their prefix, by the same bound.

Members already known to be connected are not compared again, so a group of thousands
of near copies costs a few passes, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .repeats import bodies
from .store import Cuts, keyed

ROOM = 400
LEADERS = 16
VOTES = 8
MOST_BLOCKS = 32000  # of a chunk, whose texts are in one task
HELD = "uid long, n long, tokens binary, prefix binary, votes array<long>"


def need(n, percent: int):
    """Least overlap of a set of n tokens with a partner's."""
    return -(-percent * n // 100)


def token_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; fewer words than ``size`` make one shingle."""
    out: list[np.ndarray] = []
    for part in A.chunks([(t,) for t in texts]):
        found = A.Words([r[0] for r in part], lower=True)
        codes = found.hashes()
        counts = np.diff(found.first)
        roll = A.Rolling(codes)
        gram = roll.grams(size)
        at = np.flatnonzero(found.doc[: len(gram)] == found.doc[size - 1 : size - 1 + len(gram)])
        short = np.flatnonzero((counts > 0) & (counts < size))
        value = np.concatenate([gram[at], roll.of(found.first[short], found.first[short + 1])])
        doc = np.concatenate([found.doc[at], short])
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(value) else np.zeros(0, bool)
        value, doc = value[new], doc[new]
        out += np.split(value, np.searchsorted(doc, np.arange(1, len(part))))
    return out


def _pack(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (values & A.U(0xFFFFFFFF)) % A.U(buckets), (values >> A.U(32)).astype(np.uint32)


def _steps(ascending: np.ndarray) -> bytes:
    """Differences of 32-bit numbers, their bytes by place: what is mostly zero compresses."""
    return np.diff(ascending, prepend=A.U(0).astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _summed(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def _representatives(left: pa.Table, skip: pa.Table) -> tuple[list[int], list[bytes]]:
    drop = set(skip["uid"].to_pylist())
    rows = [(u, t) for u, t in zip(left["uid"].to_pylist(), bodies(left["text"])) if u not in drop]
    return [r[0] for r in rows], [r[1] for r in rows]


def _counting(size: int, buckets: int):
    def run(left: pa.Table, skip: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        _, texts = _representatives(left, skip)
        sets = token_sets(texts, size)
        if sets and len(values := np.concatenate(sets)):
            once, n = np.unique(values, return_counts=True)
            bucket, short = _pack(once, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, short, n = bucket[order], short[order], np.minimum(n, 255).astype(np.uint8)[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            chunk = left["chunk"][0].as_py()
            for b in range(buckets):
                i, j = edges[b], edges[b + 1]
                if i < j:
                    for column, v in zip(out, (b, chunk, _steps(short[i:j]), n[i:j].tobytes())):
                        column.append(v)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(out, types)], ["bucket", "chunk", "tokens", "times"])

    return run


def _recurring(table: pa.Table) -> pa.Table:
    """Per chunk, its tokens that two documents have, and the power of two that so many have."""
    parts = [_summed(x) for x in table["tokens"].to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint8) for x in table["times"].to_pylist()])
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(which, weights=times)
    level = np.log2(total).astype(np.uint8)[which]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    kept = [(p[k], lv[k]) for p, k, lv in zip(parts, np.split(total[which] > 1, cuts), np.split(level, cuts))]
    found = [pa.array(x, pa.binary()) for x in ([_steps(p) for p, _ in kept], [lv.tobytes() for _, lv in kept])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "tokens": found[0], "levels": found[1]})


def _surviving(size: int, percent: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        uids, texts = _representatives(left, right)
        notes = [(b, t, lv) for b, t, lv in zip(*(right[k].to_pylist() for k in ("bucket", "tokens", "levels"))) if t]
        again = np.concatenate([np.zeros(0, np.uint64), *(_summed(t).astype(np.uint64) | (A.U(b) << A.U(32)) for b, t, _ in notes)])
        again, at = np.unique(again, return_index=True)
        levels = np.frombuffer(b"".join(lv for *_, lv in notes), np.uint8)[at]
        out = [[], [], [], [], []]
        sets = token_sets(texts, size)
        bucket, short = _pack(np.concatenate([np.zeros(0, np.uint64), *sets]), buckets)
        place = short.astype(np.uint64) | (bucket << A.U(32))
        at = np.minimum(np.searchsorted(again, place), max(0, len(again) - 1))
        recurs = again[at] == place if len(again) else np.zeros(len(place), bool)
        edges = np.cumsum([0, *map(len, sets)])
        for k, (uid, s) in enumerate(zip(uids, sets)):
            here = np.flatnonzero(recurs[edges[k] : edges[k + 1]])
            spare = len(here) - int(need(len(s), percent))
            lives = len(s) > 0 and spare >= 0
            tokens = prefix = votes = None
            if lives:
                rarest = np.argsort(levels[at[edges[k] + here]], kind="stable")[: spare + 1]
                head = np.sort(s[here[rarest]])
                tokens, prefix, votes = s.tobytes(), head.tobytes(), head[:VOTES].view(np.int64).tolist()
            for column, v in zip(out, (uid, len(s), tokens, prefix, votes)):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(x, t) for x, t in zip(out, types)], [x.split()[0] for x in HELD.split(", ")])

    return run


def _matrix_rows(batches):
    for batch in batches:
        for uid, n, group, prefix in zip(*(batch[k].to_pylist() for k in ("uid", "n", "grp", "prefix"))):
            tokens = np.frombuffer(prefix, np.int64)
            columns = [tokens, np.full(len(tokens), uid), np.full(len(tokens), n), np.full(len(tokens), group)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["tok", "uid", "n", "grp"])


class Sets:
    """Token sets side by side; overlap of one with all in one pass."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.union, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = codes
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(self.union), np.int64)

    def overlaps(self, tokens: np.ndarray, least: int) -> np.ndarray | None:
        """Overlap with every set, unless the overlap with their union is below ``least``."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < least:
            return None
        self.mark[at] = 1
        out = np.add.reduceat(self.mark[self.codes], self.starts)
        self.mark[at] = 0
        return out


def _find(parent: dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def open_room(uids: list[int], roles: list[int], sets: list[np.ndarray], percent: int, among: bool = True) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between members (role 0), if ``among``, and of visitors with members."""
    inside = [i for i, r in enumerate(roles) if r == 0]
    if not inside:
        return []
    members = Sets([sets[i] for i in inside])
    parent = {u: u for u in uids}
    edges: list[tuple[int, int]] = []

    def test(i: int) -> None:
        shared = members.overlaps(sets[i], int(need(len(sets[i]), percent)))
        if shared is None:
            return
        linked = 100 * shared >= percent * (members.sizes + len(sets[i]) - shared)
        for k in np.flatnonzero(linked):
            a, b = _find(parent, uids[i]), _find(parent, uids[inside[k]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((uids[i], uids[inside[k]]))

    for i, r in enumerate(roles):
        if r:
            test(i)
    todo = set(inside if among else ())
    while todo:
        roots = [_find(parent, uids[i]) for i in inside]
        names, n = np.unique(roots, return_counts=True)
        largest = names[np.argmax(n)]
        rest = [i for i, root in zip(inside, roots) if root != largest and i in todo]
        if not rest and len(names) == 1:
            break
        if not rest:
            break
        batch = rest[: max(1, len(rest) // 4)]
        for i in batch:
            test(i)
            todo.discard(i)
    return edges


def _rooms(percent: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.select(["grp", "sub", "slice", "role", "uid"]).to_pandas()
        sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        out: list[tuple[int, int]] = []
        for (*_, cut), part in group.groupby(["grp", "sub", "slice"], sort=True):
            # the same document may come as a member and as a visitor
            seen = part.sort_values(["role", "uid"]).drop_duplicates("uid")
            at = seen.index.tolist()
            if len(at) > 1:
                out += open_room(seen["uid"].tolist(), seen["role"].tolist(), [sets[i] for i in at], percent, cut == 0)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _open(cuts: Cuts, seats: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Edges found in the rooms of ``(uid, grp, sub, role)``; a room's visitors come in slices, its members to each."""
    seats = cuts.cut(seats.distinct())
    many = seats.filter("role = 2").groupBy("grp", "sub").agg(F.ceil(F.count(F.lit(1)) / (2 * ROOM)).cast("long").alias("slices"))
    many = cuts.cut(many.filter("slices > 1"))
    # both sides grow with the corpus: neither is broadcast at any size
    cut = seats.hint("merge").join(many, ["grp", "sub"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64("uid"), F.col("slices")))
    slices = F.when(F.col("role") == 2, one).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    cut = cuts.cut(cut.withColumn("slice", F.explode(slices)).drop("slices"))
    rooms = 1 + cut.count() // (2 * ROOM)
    full = cut.hint("merge").join(held.select("uid", "tokens"), "uid").withColumn("room", F.pmod(F.xxhash64("grp", "sub", "slice"), F.lit(rooms)))
    return full.groupBy("room").applyInArrow(_rooms(percent), "a long, b long")


def _groups(cuts: Cuts, held: DataFrame) -> DataFrame:
    """``(uid, n, grp, sub, subs)``: the leader of each document's group and its room."""
    votes = cuts.cut(held.select("uid", F.explode("votes").alias("tok")))
    first = cuts.cut(votes.groupBy("tok").agg(F.min("uid").alias("lead")))
    tally = votes.join(first, "tok").groupBy("uid", "lead").agg(F.count(F.lit(1)).alias("c"))
    best = tally.groupBy("uid").agg(F.max(F.struct("c", (-F.col("lead")).alias("less"))).alias("best"))
    leads = cuts.cut(best.select("uid", (-F.col("best.less")).alias("lead"), F.col("best.c").alias("c")))
    strong = leads.filter(F.col("c") >= VOTES // 2).select(F.col("uid").alias("a"), F.col("lead").alias("b"))
    roots = components(cuts, strong).select(F.col("uid").alias("lead"), "root")
    chosen = leads.join(roots, "lead", "left").select("uid", F.coalesce("root", "lead").alias("grp"))
    chosen = cuts.cut(held.select("uid", "n").join(chosen, "uid"))
    sizes = cuts.cut(chosen.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ROOM).cast("long").alias("subs")))
    return cuts.cut(chosen.join(sizes, "grp").withColumn("sub", F.pmod(F.xxhash64("uid"), F.col("subs"))))


def _visits(cuts: Cuts, held: DataFrame, groups: DataFrame, percent: int) -> DataFrame | None:
    """``(uid, grp)``: groups after its own whose union meets a document's prefix, sizes permitting; None if no token is shared."""
    tokens = held.select("uid", "prefix").join(groups.select("uid", "n", "grp"), "uid").mapInArrow(_matrix_rows, "tok long, uid long, n long, grp long")
    spread = tokens.groupBy("tok").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 != g1").select("tok")
    spread = cuts.cut(spread)
    if spread.isEmpty():
        return None
    shared = cuts.cut(tokens.hint("merge").join(spread, "tok"))
    matrix = cuts.cut(shared.groupBy("tok", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).withColumnRenamed("grp", "other"))
    near = shared.hint("merge").join(matrix, "tok").filter(F.col("other") > F.col("grp"))
    near = near.filter((F.col("lo") * percent <= F.col("n") * 100) & (F.col("hi") * 100 >= F.col("n") * percent))
    return near.select("uid", F.col("other").alias("grp")).distinct()


def _back(cuts: Cuts, held: DataFrame, named: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """``(uid, grp, sub)``: other rooms of its group whose union meets the prefix of a document of ``rest``."""
    crowd = named.join(rest.select("grp").distinct(), "grp", "left_semi").select("uid", "n", "grp", "sub", F.xxhash64("grp", "sub").alias("cell"))
    tokens = held.select("uid", "prefix").join(crowd.select("uid", "n", F.col("cell").alias("grp")), "uid").mapInArrow(_matrix_rows, "tok long, uid long, n long, grp long")
    tokens = cuts.cut(tokens)
    cells = crowd.groupBy("cell").agg(F.first("grp").alias("grp"), F.first("sub").alias("sub"))
    matrix = tokens.groupBy("tok", F.col("grp").alias("cell")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    asked = tokens.join(rest.select("uid", F.col("grp").alias("whole")), "uid").select("tok", "uid", "n", "whole", F.col("grp").alias("own"))
    near = cuts.cut(asked).hint("merge").join(matrix, "tok").filter("cell != own")
    near = near.filter((F.col("lo") * percent <= F.col("n") * 100) & (F.col("hi") * 100 >= F.col("n") * percent))
    return near.select("uid", "whole", "cell").distinct().join(cells, "cell").filter("grp = whole").select("uid", "grp", "sub")


def _links(cuts: Cuts, held: DataFrame, percent: int) -> DataFrame:
    groups = _groups(cuts, held)
    large = cuts.cut(groups.filter("subs > 1").groupBy("grp").agg(F.first("subs").alias("subs")))
    own = groups.select("uid", "grp", "sub", F.lit(0).alias("role"))
    seats = own
    crowded = not large.isEmpty()
    every = lambda df: df.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    if crowded:
        # the least members of each room, then of the group: no room is gathered whole
        per_room = groups.filter("subs > 1").groupBy("grp", "sub").agg(F.min("uid").alias("uid"))
        order = Window.partitionBy("grp").orderBy("uid")
        first = per_room.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= LEADERS)
        leaders = first.select("grp", "uid").join(large, "grp")
        seats = seats.unionByName(every(leaders).select("uid", "grp", "sub", F.lit(1).alias("role")))
    visits = _visits(cuts, held, groups, percent)
    if visits is not None:
        size = groups.groupBy("grp").agg(F.first("subs").alias("subs"))
        seats = seats.unionByName(every(visits.join(size, "grp")).select("uid", "grp", "sub", F.lit(2).alias("role")))
    edges = cuts.cut(_open(cuts, seats, held, percent))
    if not crowded:
        return edges
    roots = components(cuts, edges)
    named = groups.filter("subs > 1").join(roots, "uid", "left").select("uid", "n", "grp", "sub", F.coalesce("root", "uid").alias("root"))
    named = cuts.cut(named)
    counts = named.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("grp").agg(F.max(F.struct("c", "root")).alias("m")).select("grp", F.col("m.root").alias("main"))
    rest = cuts.cut(named.join(cuts.cut(main), "grp").filter("root != main").select("uid", "grp"))
    if rest.isEmpty():
        return edges
    back = cuts.cut(_back(cuts, held, named, rest, percent)).withColumn("role", F.lit(2))
    hosts = own.join(back.select("grp", "sub").distinct(), ["grp", "sub"], "left_semi")
    return edges.unionByName(_open(cuts, hosts.unionByName(back), held, percent))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """``(id, n_shingles, component_id)`` per input row.

    Documents link when 100 |A and B| >= ``percent`` |A or B| for their sets of distinct
    shingles of ``size`` words, A-Z lower-cased; a text of fewer words is one shingle. A
    component's id is its smallest document id. Texts without words, null ones included, have
    n_shingles 0 and are alone. Copies of a text link; rows that repeat an id, or have none, are documents
    of their own (ids then come back as they are); a text of any length is read whole; an empty
    table gives an empty result; other columns are not read. Shingles are compared by 64-bit fingerprints, copies of texts by 128 bits.
    """
    cuts = Cuts(docs.sparkSession)
    rows = keyed(cuts, docs, id_col, text_col)
    marks = rows.select("uid", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), "text").alias("x2"))
    reps = cuts.cut(marks.groupBy("x1", "x2").agg(F.min("uid").alias("rep")))
    copies = cuts.cut(marks.join(reps, ["x1", "x2"]).select("uid", "rep"))
    count = copies.count()
    per_chunk = min(MOST_BLOCKS, max(300, count // 500))
    chunks = 1 + count // per_chunk
    buckets = max(8, min(per_chunk, count // 1000))
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk")
    dealt = rows.select(chunk, "uid", "text").groupBy("chunk")
    skip = copies.filter("uid != rep").select(chunk, "uid")
    counted = dealt.cogroup(skip.groupBy("chunk")).applyInArrow(_counting(size, buckets), "bucket long, chunk long, tokens binary, times binary")
    told = counted.groupBy("bucket").applyInArrow(_recurring, "chunk long, bucket long, tokens binary, levels binary")
    nothing = [F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast("binary").alias("levels")]
    notes = told.select("chunk", F.lit(None).cast("long").alias("uid"), "bucket", "tokens", "levels").unionByName(skip.select("chunk", "uid", *nothing))
    held = cuts.cut(dealt.cogroup(notes.groupBy("chunk")).applyInArrow(_surviving(size, percent, buckets), HELD))
    roots = components(cuts, _links(cuts, held.filter("tokens is not null"), percent))
    sizes = held.select(F.col("uid").alias("rep"), "n").join(roots.withColumnRenamed("uid", "rep"), "rep", "left")
    out = copies.join(cuts.cut(sizes), "rep")
    alone = F.when(F.col("n") == 0, F.col("uid")).otherwise(F.coalesce("root", "rep"))
    out = out.select("uid", F.col("n").alias("n_shingles"), alone.alias("component"))
    if not cuts.renumbered:
        return out.select(F.col("uid").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    ids = rows.select("uid", "id")
    named = out.join(ids, "uid").join(ids.select(F.col("uid").alias("component"), F.col("id").alias("component_id")), "component")
    return named.select(F.col("id").alias(id_col), "n_shingles", "component_id")
