"""Queries over the driver's tables, one per operator of the library, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import encode as E
from ..operators import fit, metrics, mining, pool, search
from ..sources import runlog
from ..streaming import latest as stream
from .views import Views, grades

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BASE = """emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT * FROM emb WHERE vec_id % 10 = 0), d AS (SELECT * FROM emb WHERE vec_id % 10 <> 0)"""
RANKED = BASE + """, sims AS (SELECT q.vec_id AS query_id, d.vec_id AS image_id, list_dot_product(q.e, d.e) AS sim FROM q, d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, image_id) - 1 AS rank FROM sims)"""
TRUTH = RANKED + """, gt AS (SELECT q.vec_id AS query_id, d.vec_id AS image_id, CASE WHEN d.vec_id % 3 = 0 THEN CASE WHEN q.vec_id % 70 = 0 THEN 'junk' ELSE 'easy' END
WHEN d.vec_id % 3 = 1 THEN 'hard' ELSE 'junk' END AS grade FROM q JOIN d USING (label)),
roles(protocol, grade, role) AS (VALUES ('easy','easy','positive'),('easy','hard','ignored'),('easy','junk','ignored'),('medium','easy','positive'),('medium','hard','positive'),
('medium','junk','ignored'),('hard','hard','positive'),('hard','easy','ignored'),('hard','junk','ignored')),
sets AS (SELECT DISTINCT protocol, query_id, image_id, role FROM gt JOIN roles USING (grade)),
protos AS (SELECT DISTINCT protocol FROM roles),
left_over AS (SELECT p.protocol, r.query_id, r.image_id, r.rank FROM ranked r, protos p WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.protocol = p.protocol AND s.query_id = r.query_id AND s.image_id = r.image_id AND s.role = 'ignored')),
places AS (SELECT *, row_number() OVER (PARTITION BY protocol, query_id ORDER BY rank) - 1 AS pos FROM left_over),
hits AS (SELECT p.* FROM places p JOIN sets s ON s.protocol = p.protocol AND s.query_id = p.query_id AND s.image_id = p.image_id AND s.role = 'positive'),
npos AS (SELECT protocol, query_id, count(*) AS n FROM sets WHERE role = 'positive' GROUP BY ALL),
steps AS (SELECT *, row_number() OVER (PARTITION BY protocol, query_id ORDER BY pos) - 1 AS j, least(max(pos) OVER (PARTITION BY protocol, query_id) + 1, 10) AS kq FROM hits),
sums AS (SELECT protocol, query_id, sum(((CASE WHEN pos = 0 THEN 1.0::DOUBLE ELSE j::DOUBLE / pos END) + (j + 1)::DOUBLE / (pos + 1)) / 2) AS t, sum(CASE WHEN pos < kq THEN 1 ELSE 0 END)::DOUBLE / max(kq) AS p FROM steps GROUP BY ALL),
per AS (SELECT a.protocol, a.query_id, coalesce(n, 0) AS n_positive, t / n AS ap, p AS precision FROM (SELECT protocol, vec_id AS query_id FROM q, protos) a LEFT JOIN npos USING (protocol, query_id) LEFT JOIN sums USING (protocol, query_id))"""
LOCAL = BASE + """, loc AS (SELECT vec_id AS image_id, k.kp, label, list_slice(e, k.kp * 8 + 1, k.kp * 8 + 8) AS v FROM emb, (SELECT unnest(range(8)) AS kp) k WHERE k.kp < vec_id % 9),
dims AS (SELECT image_id, kp, label, i.dim, v[i.dim + 1] AS x FROM loc, (SELECT unnest(range(8)) AS dim) i),
book AS (SELECT label AS word, dim, avg(x) AS c, var_pop(x) AS var, count(*) AS n FROM dims WHERE image_id % 2 = 1 GROUP BY ALL),
dist AS (SELECT image_id, kp, word, sum((x - c) * (x - c)) AS d2 FROM dims JOIN book USING (dim) GROUP BY ALL),
near AS (SELECT image_id, kp, word FROM (SELECT *, row_number() OVER (PARTITION BY image_id, kp ORDER BY d2, word) AS r FROM dist) WHERE r = 1)"""
TF = LOCAL + """, tf AS (SELECT image_id, word, count(*) AS tf FROM near GROUP BY ALL), idf AS (SELECT w.word, CASE WHEN df IS NULL THEN 0 ELSE ln((SELECT count(*) FROM emb)::DOUBLE / df) END AS idf
FROM (SELECT DISTINCT word FROM book) w LEFT JOIN (SELECT word, count(*) AS df FROM tf GROUP BY word) USING (word)),
wt AS (SELECT image_id, word, tf * idf AS w FROM tf JOIN idf USING (word)), tfidf AS (SELECT image_id, word, CASE WHEN n = 0 THEN 0 ELSE w / n END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY image_id)) AS n FROM wt))"""
VLAD = LOCAL + """, raw AS (SELECT image_id, word, dim, sum(x - c) AS value FROM dims JOIN near USING (image_id, kp) JOIN book USING (word, dim) GROUP BY ALL),
intra AS (SELECT image_id, word, dim, CASE WHEN n = 0 THEN 0 ELSE value / n END AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY image_id, word)) AS n FROM raw)),
vlad AS (SELECT image_id, word, dim, CASE WHEN n = 0 THEN 0 ELSE value / n END AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY image_id)) AS n FROM intra))"""
GMM = LOCAL + """, gmm AS (SELECT word AS comp, dim, c AS mu, greatest(var, 1e-12) AS var, n::DOUBLE / sum(n) OVER (PARTITION BY dim) AS w FROM book),
lp AS (SELECT image_id, kp, comp, ln(any_value(w)) - 0.5 * sum(ln(2 * pi()) + ln(var) + (x - mu) * (x - mu) / var) AS lp FROM dims JOIN gmm USING (dim) GROUP BY image_id, kp, comp),
ex AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY image_id, kp)) AS ex FROM lp), post AS (SELECT image_id, kp, comp, ex / sum(ex) OVER (PARTITION BY image_id, kp) AS gamma FROM ex),
kps AS (SELECT image_id, count(*) AS n FROM loc GROUP BY 1),
fsum AS (SELECT image_id, comp, dim, any_value(w) AS w, sum(gamma * (x - mu) / sqrt(var)) AS m, sum(gamma * ((x - mu) * (x - mu) / var - 1)) AS s FROM dims JOIN post USING (image_id, kp) JOIN gmm USING (comp, dim) GROUP BY ALL),
fraw AS (SELECT image_id, comp, dim, 0 AS part, m / (n * sqrt(w)) AS value FROM fsum JOIN kps USING (image_id) UNION ALL SELECT image_id, comp, dim, 1, s / (n * sqrt(2 * w)) FROM fsum JOIN kps USING (image_id))"""
CELLS = BASE + """, flat AS (SELECT vec_id AS image_id, i.i, e[i.i + 1] AS v FROM emb, (SELECT unnest(range(64)) AS i) i),
one AS (SELECT image_id, i // 16 AS c, (i % 16) // 4 AS y, i % 4 AS x, v FROM flat),
cells AS (SELECT *, 0 AS scale FROM one UNION ALL SELECT *, 1 AS scale FROM one WHERE x % 2 = 0 AND y % 2 = 0)"""
LOG = "log AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = sql if sql.lstrip().startswith("SELECT") else "WITH " + sql
        return f

    return add


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _rank(v: Views, k: int | None = None) -> DataFrame:
    return search.rank(v.queries, v.database, k)


query("exact_rank", RANKED + " SELECT query_id, image_id, rank FROM ranked")(lambda v: _rank(v).select("query_id", "image_id", "rank"))
query("exact_top8", RANKED + " SELECT query_id, image_id, rank, round(sim, 6) AS sim FROM ranked WHERE rank < 8")(lambda v: _six(_rank(v, 8), "sim"))
query("protocol_sets", TRUTH + " SELECT * FROM sets")(lambda v: metrics.protocol_sets(v.truth, once=True))
query("filtered_positions", TRUTH + " SELECT protocol, query_id, image_id, pos FROM hits")(lambda v: metrics.filtered_positions_by(v.queries, v.database, grades))


def _per(v: Views) -> DataFrame:
    return metrics.query_metrics_by(v.queries, v.database, grades)


query("query_ap", TRUTH + " SELECT protocol, query_id, n_positive, round(ap, 6) AS ap FROM per WHERE n_positive > 0")(lambda v: _six(_per(v), "ap").filter("n_positive > 0").drop("precision"))
query("precision_at_k", TRUTH + " SELECT protocol, query_id, round(precision, 6) AS precision FROM per WHERE n_positive > 0")(lambda v: _six(_per(v), "precision").filter("n_positive > 0").select("protocol", "query_id", "precision"))
query("eval_protocols", TRUTH + """ SELECT protocol, round(avg(ap) FILTER (n_positive > 0), 6) AS map, round(avg(precision) FILTER (n_positive > 0), 6) AS mp_at_k, 10 AS k,
count(*) FILTER (n_positive > 0) AS num_queries, count(*) FILTER (n_positive = 0) AS num_excluded FROM per GROUP BY protocol""")(lambda v: _six(metrics.evaluate(_per(v)), "map", "mp_at_k"))
query("typical_query", TRUTH + ", m AS (SELECT * FROM per WHERE protocol = 'medium' AND n_positive > 0) SELECT query_id, round(ap, 6) AS ap FROM m ORDER BY abs(ap - (SELECT avg(ap) FROM m)), query_id LIMIT 1")(lambda v: _six(metrics.typical_query(_per(v), "medium"), "ap"))
query("result_status", TRUTH + """ SELECT r.query_id, r.image_id, r.rank, CASE WHEN s.role = 'ignored' THEN 'ignored' WHEN s.role = 'positive' THEN 'correct' ELSE 'wrong' END AS status
FROM ranked r LEFT JOIN sets s ON s.protocol = 'medium' AND s.query_id = r.query_id AND s.image_id = r.image_id WHERE r.rank < 8""")(lambda v: metrics.result_status_by(v.queries, v.database, grades, "medium", 8))
query("size_histogram", TRUTH + ", n AS (SELECT query_id, count(*) AS n FROM gt WHERE grade <> 'junk' GROUP BY 1) SELECT least(floor(n * 15 / 150), 14)::BIGINT AS bin, count(*) AS queries FROM n GROUP BY 1")(lambda v: metrics.set_sizes(v.truth))


def _vectors(name: str, sql: str, make) -> None:
    query(name, BASE + f" SELECT vec_id AS id, i.i AS dim, round(x[i.i + 1], 6) AS value FROM (SELECT vec_id, {sql} AS x FROM emb), (SELECT unnest(range(64)) AS i) i")(
        lambda v: _six(v.every.select("id", F.posexplode(make(F.col("vec"))).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")), "value")
    )


_vectors("l2_normalize", "list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))", V.safe_l2_normalize)
_vectors("hellinger", "list_transform(e, lambda x: sqrt(abs(x) / list_sum(list_transform(e, lambda y: abs(y)))))", lambda x: V.hellinger(F.transform(x, lambda y: F.abs(y))))
_vectors("power_law", "list_transform(e, lambda x: sign(x) * pow(abs(x), 0.5))", lambda x: V.power_law(x, 0.5))
for _name, _p, _sql in (("gem_pool", 3.0, "pow(avg(pow(greatest(v, 1e-6), 3)), 1.0::DOUBLE / 3)"), ("spoc_pool", 1.0, "avg(greatest(v, 1e-6))"), ("mac_pool", None, "max(v)")):
    query(_name, CELLS + f" SELECT image_id, c, round({_sql}, 6) AS v FROM cells WHERE scale = 0 GROUP BY ALL")(lambda v, p=_p: _six(pool.pool(v.cells.filter("scale = 0"), p).withColumn("c", F.col("c").cast("long")), "v"))
query("multiscale_gem", CELLS + """, p AS (SELECT image_id, scale, c, pow(avg(pow(greatest(v, 1e-6), 3)), 1.0::DOUBLE / 3) AS v FROM cells GROUP BY ALL),
u AS (SELECT image_id, scale, c, v / sqrt(sum(v * v) OVER (PARTITION BY image_id, scale)) AS v FROM p), g AS (SELECT image_id, c, pow(avg(pow(greatest(v, 1e-6), 3)), 1.0::DOUBLE / 3) AS v FROM u GROUP BY ALL)
SELECT image_id, c, round(v / sqrt(sum(v * v) OVER (PARTITION BY image_id)), 6) AS v FROM g""")(lambda v: _six(pool.pool_scales(v.cells, 3.0).withColumn("c", F.col("c").cast("long")), "v"))
_GRID = ", ".join(f"({i}, {y}, {x}, {s})" for i, (y, x, s, _) in enumerate(pool.regions(4, 4, 3)))
query("rmac_pool", CELLS + f""", grid(r, y0, x0, s) AS (VALUES {_GRID}), m AS (SELECT image_id, r, c, max(v) AS v FROM cells JOIN grid ON y >= y0 AND y < y0 + s AND x >= x0 AND x < x0 + s WHERE scale = 0 GROUP BY ALL),
n AS (SELECT *, greatest(sqrt(sum(v * v) OVER (PARTITION BY image_id, r)), 1e-6) AS n FROM m) SELECT image_id, c, round(sum(v / n), 6) AS v FROM n GROUP BY ALL""")(lambda v: _six(pool.rmac(v.cells.filter("scale = 0"), 4, 4).withColumn("c", F.col("c").cast("long")), "v"))
query("token_readout", BASE + " SELECT vec_id AS image_id, i.i AS dim, round((e[9 + i.i] + e[17 + i.i] + e[25 + i.i] + e[33 + i.i] + e[41 + i.i] + e[49 + i.i] + e[57 + i.i]) / 7, 6) AS v FROM emb, (SELECT unnest(range(8)) AS i) i")(
    lambda v: _six(pool.read_out(v.every.select(F.col("id").alias("image_id"), F.posexplode("vec").alias("i", "v")).select("image_id", F.floor(F.col("i") / 8).alias("pos"), (F.col("i") % 8).cast("long").alias("dim"), "v"), "mean", 1), "v")
)


def _near(v: Views) -> DataFrame:
    return search.nearest(v.local(), v.centers)


query("assign_words", LOCAL + " SELECT image_id, kp, word FROM near")(lambda v: _near(v).select("image_id", F.col("kp").cast("long").alias("kp"), "word"))
query("tf", TF + " SELECT * FROM tf")(lambda v: E.term_frequencies(_near(v)))


def _idf(v: Views) -> DataFrame:
    words = v.spark.range(len(v.centers)).select(F.col("id").cast("int").alias("word"))
    return E.inverse_document_frequency(E.term_frequencies(_near(v)), v.every, words)


def _tfidf(v: Views) -> DataFrame:
    return E.tfidf(E.term_frequencies(_near(v)), _idf(v))


query("idf", TF + " SELECT word, round(idf, 6) AS idf FROM idf")(lambda v: _six(_idf(v), "idf"))
query("tfidf_encode", TF + " SELECT image_id, word, round(w, 6) AS w FROM tfidf")(lambda v: _six(_tfidf(v), "w"))


def _cross(coded: DataFrame, key: list[str], value: str, copies: bool = False) -> DataFrame:
    return E.sparse_scores(coded.filter("image_id % 10 = 0"), coded.filter("image_id % 10 != 0"), key, value, digits=6, copies=copies)


query("bow_rank", TF + " SELECT a.image_id AS query_id, b.image_id, round(sum(a.w * b.w), 6) AS sim FROM tfidf a JOIN tfidf b USING (word) WHERE a.image_id % 10 = 0 AND b.image_id % 10 <> 0 GROUP BY ALL")(lambda v: _cross(_tfidf(v), ["word"], "w", copies=True))
query("vlad_raw", VLAD + " SELECT image_id, word, dim, round(value, 6) AS value FROM raw")(lambda v: _six(E.vlad_raw(v.local(), v.centers).withColumn("dim", F.col("dim").cast("long")), "value"))
query("vlad_encode", VLAD + " SELECT image_id, word, dim, round(value, 6) AS value FROM vlad")(lambda v: _six(E.vlad_encode(E.vlad_raw(v.local(), v.centers)).withColumn("dim", F.col("dim").cast("long")), "value"))
query("vlad_rank", VLAD + " SELECT a.image_id AS query_id, b.image_id, round(sum(a.value * b.value), 6) AS sim FROM vlad a JOIN vlad b USING (word, dim) WHERE a.image_id % 10 = 0 AND b.image_id % 10 <> 0 GROUP BY ALL")(lambda v: _cross(E.vlad_encode(E.vlad_raw(v.local(), v.centers)), ["word", "dim"], "value"))
query("gmm_posteriors", GMM + " SELECT image_id, kp, comp, round(gamma, 6) AS gamma FROM post")(lambda v: _six(E.posteriors(v.local(), v.mixture).select("image_id", F.col("kp").cast("long").alias("kp"), "comp", "gamma"), "gamma"))


def _fisher(v: Views) -> DataFrame:
    return E.fisher_raw(v.local(), v.mixture).select("image_id", "comp", F.col("dim").cast("long").alias("dim"), "part", "value")


query("fisher_raw", GMM + " SELECT image_id, comp, dim, part, round(value, 6) AS value FROM fraw")(lambda v: _six(_fisher(v), "value"))
query("fisher_encode", GMM + ", p AS (SELECT *, sign(value) * sqrt(abs(value)) AS z FROM fraw) SELECT image_id, comp, dim, part, round(z / sqrt(sum(z * z) OVER (PARTITION BY image_id)), 6) AS value FROM p")(lambda v: _six(E.fisher_encode(_fisher(v)), "value"))
query("lloyd_step", LOCAL + " SELECT word, dim, round(avg(x), 6) AS c FROM dims JOIN near USING (image_id, kp) GROUP BY ALL")(lambda v: _six(fit.lloyd_step(v.local(), v.centers).withColumn("dim", F.col("dim").cast("long")), "c"))
query("em_step", GMM + """, s AS (SELECT comp, dim, sum(gamma) AS n, sum(gamma * x) AS s, sum(gamma * x * x) AS q FROM post JOIN dims USING (image_id, kp) GROUP BY ALL)
SELECT comp, dim, round(n / (SELECT count(*) FROM loc), 6) AS weight, round(s / n, 6) AS mean, round(greatest(q / n - (s / n) * (s / n), 1e-12), 6) AS variance FROM s""")(lambda v: _six(fit.em_step(v.local(), v.mixture).withColumn("dim", F.col("dim").cast("long")), "weight", "mean", "variance"))
FLAT = BASE + ", f AS (SELECT vec_id, i.i, e[i.i + 1] AS x FROM emb, (SELECT unnest(range(64)) AS i) i)"
query("covariance_gram", FLAT + " SELECT a.i::INT AS i, b.i::INT AS j, round((sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*)) / (count(*) - 1), 6) AS cov FROM f a JOIN f b USING (vec_id) GROUP BY ALL")(lambda v: _six(fit.covariance(v.every), "cov"))


def _pairs(v: Views) -> DataFrame:
    """Each database item with the least of its label."""
    d = v.database.select("id", "label")
    return d.join(d.groupBy("label").agg(F.min("id").alias("p")), "label").filter("id != p").select(F.col("id").alias("q"), "p")


PAIRS = BASE + ", pairs AS (SELECT vec_id AS q, p FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS p FROM d) WHERE vec_id <> p)"
query("pair_intra_cov", PAIRS + """, diff AS (SELECT q, i.i, a.e[i.i + 1] - b.e[i.i + 1] AS x FROM pairs JOIN emb a ON a.vec_id = q JOIN emb b ON b.vec_id = p, (SELECT unnest(range(64)) AS i) i)
SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.x * b.x) / count(*), 6) AS cov FROM diff a JOIN diff b USING (q) GROUP BY ALL""")(lambda v: _six(fit.gram(fit.pair_differences(v.every, _pairs(v))).select("i", "j", (F.col("g") / F.col("n")).alias("cov")), "cov"))
query("pca_fit")(lambda v: fit.pca_fit(v.every, 16, True).transform(v.every).select("id", "vec"))
query("supervised_whitening")(lambda v: fit.supervised_whitening(v.every, _pairs(v)).transform(v.every).select("id", "vec"))
query("pair_endpoints", PAIRS + " SELECT q AS id FROM pairs UNION SELECT p FROM pairs")(lambda v: mining.pair_endpoints(_pairs(v)))
query("dense_remap", PAIRS + ", ids AS (SELECT q AS id FROM pairs UNION SELECT p FROM pairs) SELECT id, row_number() OVER (ORDER BY id) - 1 AS dense FROM ids")(lambda v: mining.dense_remap(mining.pair_endpoints(_pairs(v))))
query("offsets", "SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS offset_end FROM conversations")(
    lambda v: v.table("conversations").select("conv_id", "turn", F.sum(F.length("text").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("offset_end"))
)


def _mined(v: Views) -> DataFrame:
    return mining.hardest(v.queries, v.database)


MINED = RANKED + """, o AS (SELECT s.query_id, s.image_id, d.label AS cluster, s.sim FROM sims s JOIN q ON q.vec_id = s.query_id JOIN d ON d.vec_id = s.image_id WHERE q.label <> d.label),
o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cluster ORDER BY sim DESC, image_id) AS r FROM o) WHERE r = 1),
mined AS (SELECT query_id, image_id, cluster, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, image_id))::INT AS rank FROM o1) WHERE rank <= 5)"""
query("mine_negatives", MINED + " SELECT * FROM mined")(_mined)


def _tuples(v: Views) -> DataFrame:
    vec = v.every.select("id", "vec")
    neg = _mined(v).join(vec.withColumnRenamed("id", "image_id"), "image_id").groupBy("query_id").agg(F.collect_list("vec").alias("negatives"))
    first = v.database.groupBy("label").agg(F.min("id").alias("p"))
    q = v.queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q"), "label").join(first, "label")
    return q.join(vec.select(F.col("id").alias("p"), F.col("vec").alias("pv")), "p").join(neg, "query_id").select("query_id", "q", F.col("pv").alias("p"), "negatives")


query("contrastive_loss", MINED + """, h AS (SELECT m.query_id, sum(pow(greatest(1.6 - list_distance(q.e, n.e), 0), 2)) AS h FROM mined m JOIN q ON q.vec_id = m.query_id JOIN emb n ON n.vec_id = m.image_id GROUP BY 1),
p AS (SELECT label, min(vec_id) AS p FROM d GROUP BY 1) SELECT q.vec_id AS query_id, round(0.5 * (pow(list_distance(q.e, x.e), 2) + h.h), 6) AS loss FROM q JOIN h ON h.query_id = q.vec_id JOIN p USING (label) JOIN emb x ON x.vec_id = p.p""")(lambda v: _six(mining.contrastive_loss(_tuples(v), 1.6), "loss"))
SELF = BASE + """, s AS (SELECT a.vec_id AS id, a.label, b.label AS other, list_dot_product(a.e, b.e) AS sim, b.vec_id FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, vec_id) AS r FROM s) WHERE r = 1)"""
query("koleo", SELF + " SELECT round(avg(-ln(sqrt(greatest(2 - 2 * sim, 0)) + 1e-8)), 4) AS koleo FROM n")(lambda v: mining.koleo(v.every).select(F.round("koleo", 4).alias("koleo")))
query("knn_p_at_1", SELF + " SELECT round(avg(CASE WHEN label = other THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision_at_1 FROM n")(lambda v: _six(mining.knn_precision(v.every, v.every), "precision_at_1"))


def _log(v: Views) -> DataFrame:
    return v.table("events").withColumn("k", F.get_json_object("props", "$.k"))


query("run_latest", LOG + " SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM log) WHERE r = 1")(lambda v: runlog.latest(_log(v), [F.col("user_id"), F.col("event_type")], "event_id").select("user_id", "event_type", "event_id", "value"))
query("run_tidy", LOG + " SELECT event_id, unnest(['double', 'single']) AS protocol, unnest([2 * value, value]) AS map FROM log")(
    lambda v: _log(v).select("event_id", F.explode(F.map_entries(F.create_map(F.lit("double"), 2 * F.col("value"), F.lit("single"), F.col("value")))).alias("m")).select("event_id", F.col("m.key").alias("protocol"), F.col("m.value").alias("map"))
)
query("run_best_k", LOG + " SELECT event_type, arg_max(k, struct_pack(v := value, e := -event_id)) AS k, max(value) AS best FROM log GROUP BY 1")(lambda v: _log(v).groupBy("event_type").agg(F.max_by("k", F.struct("value", -F.col("event_id"))).alias("k"), F.max("value").alias("best")))
_EVENTS = ["click", "view"]
query("run_pivot", LOG + " SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM log GROUP BY 1 HAVING click IS NOT NULL AND view IS NOT NULL")(lambda v: _log(v).groupBy("user_id").pivot("event_type", _EVENTS).agg(F.max("value")).na.drop())
query("run_sorted", LOG + " SELECT event_id, row_number() OVER (ORDER BY event_type, coalesce(TRY_CAST(k AS INT), 0), event_id) AS place FROM (SELECT * FROM log ORDER BY event_type, coalesce(TRY_CAST(k AS INT), 0), event_id LIMIT 20)")(
    lambda v: _log(v).withColumn("n", F.coalesce(F.col("k").try_cast("int"), F.lit(0))).orderBy("event_type", "n", "event_id").limit(20).withColumn("place", F.row_number().over(Window.orderBy("event_type", "n", "event_id")).cast("long")).select("event_id", "place")
)
query("run_increments", LOG + ", m AS (SELECT event_type, TRY_CAST(k AS INT) AS k, avg(value) AS map FROM log GROUP BY ALL) SELECT event_type, k, round(map - lag(map) OVER (PARTITION BY event_type ORDER BY k), 6) AS gain FROM m")(
    lambda v: _six(_log(v).groupBy("event_type", F.col("k").try_cast("int").alias("k")).agg(F.avg("value").alias("map")).select("event_type", "k", (F.col("map") - F.lag("map").over(Window.partitionBy("event_type").orderBy("k"))).alias("gain")), "gain")
)
query("run_dim", LOG + " SELECT event_id, CASE event_type WHEN 'click' THEN TRY_CAST(k AS INT) WHEN 'view' THEN 128 * TRY_CAST(k AS INT) END AS dim FROM log")(
    lambda v: _log(v).select("event_id", runlog.descriptor_dim(F.when(F.col("event_type") == "click", "bow").when(F.col("event_type") == "view", "vlad"), F.create_map(F.lit("k"), F.col("k"))).alias("dim"))
)
query("run_names", LOG + " SELECT event_id, event_type || '-d-k' || k AS name, 'k=' || k AS params FROM log")(
    lambda v: _log(v).withColumn("p", F.create_map(F.lit("k"), F.col("k"))).select("event_id", T.run_name(F.col("event_type"), F.lit("d"), F.col("p")).alias("name"), T.format_params(F.col("p")).alias("params"))
)
query("conditional_best", LOG + " SELECT user_id, max(value) FILTER (event_type = 'view') AS best, min(value) AS low FROM log GROUP BY 1")(lambda v: _log(v).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("best"), F.min("value").alias("low")))
query("distinct_having", LOG + " SELECT user_id, count(DISTINCT event_type) AS kinds FROM log GROUP BY 1 HAVING kinds > 1")(lambda v: _log(v).groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds")).filter("kinds > 1"))
query("missing_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")(lambda v: v.table("documents").select("doc_id").exceptAll(v.table("labels").select("doc_id").distinct()))
query("availability", LOG + " SELECT user_id FROM log GROUP BY 1 HAVING list_contains(list(event_type), 'click') AND list_contains(list(event_type), 'view')")(lambda v: _log(v).groupBy("user_id").agg(F.collect_set("event_type").alias("s")).filter(F.array_contains("s", "click") & F.array_contains("s", "view")).select("user_id"))
query("seeded_sample", "SELECT vec_id AS id FROM embeddings ORDER BY (vec_id * 2654435761 + 7) % 4294967296, vec_id LIMIT 100")(lambda v: fit.seeded_sample(v.every.select("id"), "id", 100, 7))
query("url_family", "SELECT page_id, split_part(url, '-', 1) AS family, string_split(url, '/')[-1] AS leaf FROM pages")(lambda v: v.table("pages").select("page_id", T.family(F.col("url")).alias("family"), T.path_segment(F.col("url"), -1).alias("leaf")))
query("text_tfidf", """w AS (SELECT doc_id AS image_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents), t AS (SELECT * FROM w WHERE word <> ''),
top AS (SELECT word FROM t GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 500), tf AS (SELECT image_id, word, count(*) AS tf FROM t JOIN top USING (word) GROUP BY ALL),
idf AS (SELECT word, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM tf GROUP BY 1), x AS (SELECT image_id, word, tf * idf AS w FROM tf JOIN idf USING (word)),
n AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY image_id)) AS n FROM x) SELECT image_id, word, round(CASE WHEN n = 0 THEN 0 ELSE w / n END, 6) AS w FROM n""")(
    lambda v: _six(_text(v, 500), "w")
)
query("text_tfidf_all")(lambda v: _six(_text(v), "w"))


def _text(v: Views, most: int | None = None) -> DataFrame:
    docs = v.table("documents")
    tf = E.term_frequencies(E.text_words(docs, most))
    return E.tfidf(tf, E.seen_idf(tf, docs))


def _stream(v: Views) -> DataFrame:
    schema = v.table("events").schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    rows = v.spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir).select("user_id", "event_type", "event_id", "value")
    return stream.run_to_end(stream.latest_by_key(rows, ["user_id", "event_type"], "event_id"), "vecsieve_latest")


query("stream_latest", LOG + " SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM log) WHERE r = 1")(_stream)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full ranking of all queries, scored under the three protocols."""
    return QUERIES["eval_protocols"](spark, sf_dir)
