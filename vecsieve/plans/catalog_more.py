"""Queries of the run log, corpus and set operators over the driver's tables, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import analytics as A
from ..operators import encode as E
from ..operators import fit, mining, pool, search
from ..sources import corpus, runlog, tables, tracking
from .catalog import BASE, CELLS, LOCAL, PAIRS, TF, _near, _pairs, _six, query
from .views import CHECKPOINT, MODELS, Views

REC = f"""ev AS (SELECT *, json_extract_string(props, '$.k') AS k, event_id AS n FROM events),
typed AS (SELECT *, ['bow', 'vlad', 'fisher', 'gem', 'vit'][n % 5 + 1] AS technique, ['{MODELS[0]}', '{MODELS[1]}', '{MODELS[2]}'][n % 3 + 1] AS model, ['vgg16', 'resnet101'][n % 2 + 1] AS backbone,
CASE WHEN n % 4 = 0 THEN 518 ELSE 224 END AS image_size, CASE WHEN n % 6 = 0 THEN 'true' ELSE 'false' END AS whiten, CASE WHEN n % 7 = 0 THEN '{CHECKPOINT}' END AS checkpoint FROM ev),
rec AS (SELECT n AS seq, CASE WHEN user_id % 2 = 0 THEN 'roxford5k' ELSE 'rparis6k' END AS dataset, CASE WHEN user_id % 2 = 0 THEN 'rparis6k' ELSE 'roxford5k' END AS held_out_dataset, technique, model, backbone, image_size, whiten, checkpoint, k, value,
CASE WHEN technique NOT IN ('gem', 'vit') THEN k END AS own_k, CASE WHEN n % 2 = 0 THEN value END AS seconds, 'c' || n % 3 AS "commit", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS recorded_at FROM typed),
keyed AS (SELECT *, CASE technique WHEN 'vit' THEN '{{' || CASE WHEN checkpoint IS NULL THEN '' ELSE '"checkpoint": "' || checkpoint || '", ' END || '"image_size": ' || image_size || ', "model": "' || model || '", "whiten": ' || whiten || '}}'
WHEN 'gem' THEN '{{"backbone": "' || backbone || '", "lr": 5e-07, "p": 3.0, "scales": [1.0, 0.7071067811865476]}}' ELSE '{{"k": ' || k || ', "seed": 0}}' END AS params FROM rec),
tidy AS (SELECT r.*, p.protocol, value * p.share AS map FROM keyed r, (VALUES ('easy', 1.0::DOUBLE), ('hard', 0.5::DOUBLE), ('medium', 0.75::DOUBLE)) p(protocol, share))"""
NAME = """technique || '-' || dataset || '-' || CASE technique WHEN 'vit' THEN CASE WHEN checkpoint IS NULL THEN '' ELSE 'checkpoint' || checkpoint || '-' END || 'image_size' || image_size || '-model' || model || '-whiten' || CASE whiten WHEN 'true' THEN 'True' ELSE 'False' END
WHEN 'gem' THEN 'backbone' || backbone || '-lr5e-07-p3-scales1|0.707107' ELSE 'k' || k || '-seed0' END"""
WIDTH = """CASE technique WHEN 'bow' THEN k::INT WHEN 'vlad' THEN 128 * k::INT WHEN 'fisher' THEN 256 * k::INT WHEN 'gem' THEN CASE backbone WHEN 'vgg16' THEN 512 ELSE 2048 END
ELSE CASE model WHEN 'dinov2-vits14' THEN 384 WHEN 'deit-vitb16-dist-224' THEN 768 ELSE 1024 END END"""


def _canon():
    return runlog.canonical(F.col("params"))


def _tidy(v: Views) -> DataFrame:
    return runlog.tidy(v.records)


query("log_tidy", REC + f" SELECT dataset, held_out_dataset, technique, protocol, round(map, 6) AS map, value AS mp_at_k, 10 AS k, 70 AS num_queries, 0 AS num_excluded, {WIDTH} AS dim, seconds, \"commit\", recorded_at FROM tidy")(lambda v: _six(_tidy(v).drop("params"), "map"))
query("log_flat", REC + " SELECT seq, protocol || '/map' AS name, round(map, 6) AS v FROM tidy UNION ALL SELECT seq, protocol || '/mp_at_k', value FROM tidy UNION ALL SELECT seq, protocol || '/k', 10 FROM tidy UNION ALL SELECT seq, protocol || '/num_queries', 70 FROM tidy UNION ALL SELECT seq, protocol || '/num_excluded', 0 FROM tidy UNION ALL SELECT seq, 'seconds', seconds FROM keyed WHERE seconds IS NOT NULL")(lambda v: _six(runlog.flatten_metrics(v.records).select("seq", F.explode("metrics").alias("name", "v")), "v"))
query("log_key", REC + " SELECT seq, params FROM keyed")(lambda v: v.records.select("seq", _canon().alias("params")))
query("log_current", REC + " SELECT dataset, technique, params, max(seq) AS seq FROM keyed GROUP BY ALL")(lambda v: runlog.current(v.records).select("dataset", "technique", _canon().alias("params"), "seq"))
query("log_first_seen", REC + " SELECT max(seq) AS seq, row_number() OVER (ORDER BY min(seq)) - 1 AS place FROM keyed GROUP BY dataset, technique, params")(
    lambda v: runlog.first_seen(v.records, [F.col("dataset"), F.col("technique"), _canon()]).select("seq", "place")
)
query("log_display", REC + " SELECT seq FROM keyed ORDER BY dataset, technique, coalesce(own_k::INT, 0), params, recorded_at, seq LIMIT 50")(
    lambda v: runlog.display_order(v.records.withColumn("params", _canon()).withColumn("recorded_at", F.concat("recorded_at", F.lpad(F.col("seq").cast("string"), 12, "0")))).limit(50).select("seq")
)
query("log_show", REC + " SELECT dataset, technique, params, printf('%.4f', value) AS easy, printf('%.4f', value * 0.75) AS medium, printf('%.4f', value * 0.5) AS hard, left(recorded_at, 10) AS date FROM keyed WHERE dataset = 'rparis6k' AND technique = 'vlad'")(
    lambda v: runlog.show(v.records.withColumn("params", _canon()), "rparis6k", "vlad")
)
query("log_config", REC + """ SELECT seq, u.name, u.v FROM keyed, (SELECT unnest(['dataset', 'held_out_dataset', 'technique', 'commit', 'k', 'seed']) AS name) n, LATERAL (SELECT n.name, CASE n.name WHEN 'dataset' THEN dataset WHEN 'held_out_dataset' THEN held_out_dataset
WHEN 'technique' THEN technique WHEN 'commit' THEN "commit" WHEN 'k' THEN k ELSE '0' END AS v) u WHERE technique = 'bow'""")(lambda v: runlog.config_of(v.records.filter("technique = 'bow'")).select("seq", F.explode("config").alias("name", "v")))
query("log_run_names", REC + f" SELECT seq, {NAME} AS run FROM keyed")(lambda v: tracking.names(v.records).select("seq", "run"))
query("log_tracked", REC + f" SELECT {NAME} AS run, technique, round(value * 0.5, 6) AS hard FROM keyed")(lambda v: _six(tracking.tracked(v.records).select("run", F.col("config")["technique"].alias("technique"), F.col("metrics")["hard/map"].alias("hard")), "hard"))
query("log_widths", REC + f" SELECT seq, {WIDTH} AS dim FROM keyed")(lambda v: v.records.select("seq", runlog.descriptor_dim(F.col("technique"), runlog.params_map(F.col("params"))).alias("dim")))


def _k(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", A.parameter("k").cast("int"))


query("log_best_k", REC + """, m AS (SELECT technique, own_k::INT AS k, map, dataset FROM tidy WHERE protocol = 'medium' AND own_k IS NOT NULL), b AS (SELECT technique, k FROM (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY map DESC, k) AS r FROM m) WHERE r = 1)
SELECT technique, k, dataset, round(map, 6) AS map FROM m JOIN b USING (technique, k)""")(lambda v: _six(A.best_rows(_k(_tidy(v)).filter("protocol = 'medium' and k is not null"), ["technique"], "k", "map").select("technique", "k", "dataset", "map"), "map"))
query("log_two_level", REC + """ SELECT technique, round(avg(map) FILTER (dataset = 'roxford5k' AND protocol = 'medium'), 4) AS "roxford5k/medium", round(avg(map) FILTER (dataset = 'rparis6k' AND protocol = 'hard'), 4) AS "rparis6k/hard" FROM tidy GROUP BY 1""")(
    lambda v: A.two_level(_tidy(v), "technique", ["dataset", "protocol"], "map", ["roxford5k/medium", "rparis6k/hard"]).select("technique", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in ("roxford5k/medium", "rparis6k/hard")])
)
query("log_complete_pivot", REC + " SELECT k::INT AS k, max(value * 0.5) FILTER (technique = 'bow') AS bow, max(value * 0.5) FILTER (technique = 'vlad') AS vlad FROM rec WHERE own_k IS NOT NULL GROUP BY 1 HAVING bow IS NOT NULL AND vlad IS NOT NULL")(
    lambda v: A.complete_pivot(_k(_tidy(v).filter("protocol = 'hard' and technique in ('bow', 'vlad', 'fisher')")), "k", "technique", "map", ["bow", "vlad"])
)


def _vit(v: Views) -> DataFrame:
    rows = _tidy(v).filter("technique = 'vit'")
    return rows.withColumns({c: A.parameter(c) for c in ("model", "image_size", "checkpoint")})


query("log_at_protocol", REC + " SELECT model, protocol, count(*) AS n FROM tidy WHERE technique = 'vit' AND whiten = 'false' AND (image_size = 224 OR model LIKE 'siglip2%' OR model LIKE 'deit%') GROUP BY ALL")(lambda v: A.at_protocol(_vit(v)).groupBy("model", "protocol").agg(F.count(F.lit(1)).alias("n")))
VIT = REC + ", vit AS (SELECT * FROM tidy WHERE technique = 'vit'), frozen AS (SELECT model, image_size, dataset, protocol, max(map) AS before FROM vit WHERE checkpoint IS NULL GROUP BY ALL)"
query("log_before_after", VIT + " SELECT v.model, v.dataset, v.protocol, v.recorded_at, round(before, 6) AS before, round(map - before, 6) AS change FROM vit v LEFT JOIN frozen USING (model, image_size, dataset, protocol) WHERE checkpoint IS NOT NULL")(
    lambda v: _six(A.before_after(_vit(v).filter("checkpoint is not null"), _vit(v).filter("checkpoint is null"), ["model", "image_size", "dataset", "protocol"], "map").select("model", "dataset", "protocol", "recorded_at", "before", "change"), "before", "change")
)
TARGETS = [("deit-vitb16-dist-224", "hard", 0.174), ("deit-vitb16-dist-224", "medium", 0.395)]
query("log_targets", VIT + " SELECT model, protocol, recorded_at, round(map, 6) AS map, CASE WHEN model = 'deit-vitb16-dist-224' AND protocol = 'hard' THEN 0.174::DOUBLE WHEN model = 'deit-vitb16-dist-224' AND protocol = 'medium' THEN 0.395::DOUBLE END AS target FROM vit")(
    lambda v: _six(A.with_targets(_vit(v), TARGETS, ["model", "protocol"], "model string, protocol string").select("model", "protocol", "recorded_at", "map", "target"), "map")
)
query("log_in_order", REC + " SELECT technique, row_number() OVER (ORDER BY min(list_position(['vlad', 'bow', 'fisher', 'gem', 'vit'], technique))) - 1 AS place FROM keyed GROUP BY 1")(lambda v: A.in_order(v.records, "technique", A.category("technique", ["vlad", "bow", "fisher", "gem", "vit"])))
query("log_category_sort", REC + " SELECT seq, row_number() OVER (ORDER BY coalesce(list_position(['vlad', 'bow'], technique), 3), seq) - 1 AS place FROM keyed ORDER BY place LIMIT 40")(lambda v: v.records.orderBy(A.category("technique", ["vlad", "bow"]), "seq").limit(40).transform(lambda d: A.in_order(d, "seq", A.category("technique", ["vlad", "bow"]))))
query("log_increments", REC + ", m AS (SELECT technique, own_k::INT AS k, avg(map) AS map FROM tidy WHERE own_k IS NOT NULL GROUP BY ALL) SELECT technique, k, round(map - lag(map) OVER (PARTITION BY technique ORDER BY k), 6) AS gain FROM m")(
    lambda v: _six(A.increments(_k(_tidy(v)).filter("k is not null").groupBy("technique", "k").agg(F.avg("map").alias("map")), "technique", "k", "map"), "gain")
)
query("log_available", REC + " SELECT recorded_at[:10] AS day FROM keyed GROUP BY 1 HAVING list_contains(list(technique), 'bow') AND list_contains(list(technique), 'vit')")(lambda v: A.available(v.records.withColumn("day", F.left("recorded_at", F.lit(10))), "day", "technique", ["bow", "vit"]))
query("log_several", REC + " SELECT \"commit\", count(DISTINCT technique) AS kinds FROM keyed GROUP BY 1 HAVING kinds > 1")(lambda v: A.several(v.records, "commit", "technique"))
query("log_best_where", REC + " SELECT dataset, max(map) FILTER (technique = 'gem') AS best, min(map) AS low FROM tidy WHERE protocol = 'easy' GROUP BY 1")(lambda v: A.best_where(_tidy(v).filter("protocol = 'easy'"), "dataset", F.col("technique") == "gem", "map"))


def _points(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("props").alias("metrics"))


query("curve_last", "SELECT event_type AS run, max(event_id) AS step, arg_max(json_extract_string(props, '$.k')::DOUBLE, event_id) AS value FROM events GROUP BY 1")(lambda v: tracking.last_points(tracking.curves(_points(v), "k")))
query("curve_stop", """c AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS epoch, value AS score FROM events), b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c),
g AS (SELECT *, max(CASE WHEN m IS NULL OR score > m + 0.001 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS gained FROM b), e AS (SELECT run, coalesce(min(epoch) FILTER (epoch - gained >= 5), max(epoch)) AS stop FROM g GROUP BY 1)
SELECT run, count(*) AS epochs, max(score) AS best FROM c JOIN e USING (run) WHERE epoch <= stop GROUP BY 1""")(lambda v: mining.stopped_epochs(_curve(v)))


def _curve(v: Views) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return v.table("events").select(F.col("user_id").alias("run"), place.alias("epoch"), F.col("value").alias("score"))


query("number_text", "SELECT l_orderkey, l_linenumber, printf('%g', l_extendedprice * 100) AS a, printf('%g', l_discount / 1000) AS b, printf('%g', l_quantity) AS c FROM lineitem")(
    lambda v: v.table("lineitem").select("l_orderkey", "l_linenumber", T.format_number(F.col("l_extendedprice") * 100).alias("a"), T.format_number(F.col("l_discount") / 1000).alias("b"), T.format_number(F.col("l_quantity")).alias("c"))
)
query("mirror_names", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'imagenet-' || c_nationkey || '/imagenet-' || c_nationkey || '-features-' || c_custkey ELSE 'retrieval-sfm120k-vgg16/retrievalSfM120k-vgg16-' || c_custkey END || '.safetensors' AS name FROM customer")(
    lambda v: v.table("customer").select("c_custkey", T.mirrored(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x/imagenet-"), "c_nationkey", F.lit("-features-"), "c_custkey", F.lit(".pth"))).otherwise(F.concat(F.lit("retrievalSfM120k-vgg16-"), "c_custkey", F.lit(".pth"))), {"retrievalSfM120k": "retrieval-sfm120k"}).alias("name"))
)
query("run_name_parts", "SELECT s_suppkey, 1e-5::DOUBLE * s_nationkey AS lr, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::INT END AS rank, 'a/run-lr' || s_nationkey || 'e-05-' || CASE WHEN s_suppkey % 2 = 0 THEN 'lora' || s_suppkey || '-' ELSE '' END || 'seed0.safetensors' AS name FROM supplier")(
    lambda v: v.table("supplier").withColumn("run", F.concat(F.lit("run-lr"), "s_nationkey", F.lit("e-05-"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("lora"), "s_suppkey", F.lit("-"))).otherwise(""), F.lit("seed0")))
    .select("s_suppkey", (F.round(T.learning_rate(F.col("run")) * 1e5) * 1e-5).alias("lr"), T.lora_rank(F.col("run")).alias("rank"), T.trained(F.col("run"), {"run-": "a"}).alias("name"))
)
query("hash_paths", "SELECT p_partkey, 'root/' || right(c, 2) || '/' || left(right(c, 4), 2) || '/' || left(right(c, 6), 2) || '/' || c AS path FROM (SELECT p_partkey, md5(p_partkey::VARCHAR) AS c FROM part)")(lambda v: v.table("part").select("p_partkey", T.reversed_hash_path("root", F.md5(F.col("p_partkey").cast("string").cast("binary"))).alias("path")))
query("manifest_paths", "SELECT p_partkey AS place, 'root/' || right(c, 2) || '/' || left(right(c, 4), 2) || '/' || left(right(c, 6), 2) || '/' || c AS path FROM (SELECT p_partkey, md5(p_partkey::VARCHAR) AS c FROM part)")(
    lambda v: v.table("part").select(F.col("p_partkey").alias("place"), F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("cid")).transform(lambda m: corpus.manifest_paths(m, m.select(T.reversed_hash_path("root", F.col("cid")).alias("path")), "root"))
)
query("sizes", "SELECT p_partkey, greatest(14, (round_even(p_size * 10.0 / 14, 0) * 14)::INT) AS side, round(greatest(least(1.0, 1024 / greatest(p_size * 40.0, p_partkey + 1)) * 0.5, 32 / least(p_size * 40.0, p_partkey + 1)), 6)::DOUBLE AS scale, round_even(p_size * 0.5, 0)::BIGINT AS x, round_even(p_retailprice, 0)::BIGINT AS y FROM part")(
    lambda v: v.table("part").select("p_partkey", V.patch_side(F.col("p_size") * 10, 14).alias("side"), F.round(V.input_scale(F.col("p_size") * 40.0, F.col("p_partkey") + 1, 1024, 0.5, 32), 6).alias("scale"), V.crop_box(F.array(F.col("p_size") * 0.5, F.col("p_retailprice")))[0].alias("x"), V.crop_box(F.array(F.col("p_size") * 0.5, F.col("p_retailprice")))[1].alias("y"))
)
query("zip_strict", "SELECT c_custkey, c_name, c_acctbal FROM customer")(lambda v: corpus.zip_strict(v.table("customer").select("c_custkey", "c_name"), v.table("customer").select("c_custkey", "c_acctbal"), "c_custkey"))


def _corpus(v: Views, odd: int) -> corpus.Corpus:
    images = v.every.filter(F.col("id") % 2 == odd).select("id", F.col("id").cast("string").alias("cid"), F.when(F.col("label") < 7, F.col("label") + 100 * odd).otherwise(F.col("label")).alias("cluster"))
    return corpus.Corpus(images, _pairs(v).withColumn("pair_id", F.col("q")))


query("shared_clusters", "SELECT DISTINCT label AS cluster FROM embeddings WHERE label >= 7")(lambda v: corpus.shared_clusters(_corpus(v, 0), _corpus(v, 1)))
query("union_all", "SELECT vec_id AS id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0")(lambda v: v.every.select("id").unionByName(v.queries.select("id")))
query("distinct_in_order", "SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS place FROM embeddings GROUP BY 1")(lambda v: A.in_order(v.every, "label", F.col("id")))
query("epoch_pairs", PAIRS + " SELECT count(*) AS pairs, count(DISTINCT q) AS different, 300 AS pool FROM (SELECT q FROM pairs ORDER BY q LIMIT 200)")(
    lambda v: _epoch(v, 3).crossJoin(_epoch(v, 3).select(F.col("pairs").alias("again"))).filter("pairs = again").drop("again")
)


def _epoch(v: Views, seed: int) -> DataFrame:
    some, rows = mining.sample_epoch(_pairs(v).withColumn("pair_id", F.col("q")), v.every.select("id"), 200, 300, seed)
    n = rows.agg(F.count(F.lit(1)).cast("int").alias("pool"))
    return some.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("q").alias("different")).join(n)


query("key_differences", "SELECT doc_id::VARCHAR AS key, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 10 <> 7 AND doc_id::VARCHAR NOT LIKE '1%' UNION ALL SELECT item_id::VARCHAR || '+', 'unexpected' FROM benchmark")(
    lambda v: tables.key_differences(v.table("documents").select(F.col("doc_id").cast("string").alias("key")), v.table("labels").select(F.col("doc_id").cast("string").alias("key")).distinct().unionByName(v.table("benchmark").select(F.concat("item_id", F.lit("+")).alias("key"))), ("7",), ("1",))
)
query("cls_token", BASE + " SELECT vec_id AS image_id, i.i AS dim, round(e[1 + i.i], 6) AS v FROM emb, (SELECT unnest(range(8)) AS i) i")(lambda v: _six(pool.read_out(v.tokens, "cls", 1), "v"))
query("gem_tokens", BASE + " SELECT vec_id AS image_id, i.i AS dim, round(pow((SELECT avg(pow(greatest(e[1 + t * 8 + i.i], 1e-6), 3)) FROM (SELECT unnest(range(1, 8)) AS t)), 1.0::DOUBLE / 3), 6) AS v FROM emb, (SELECT unnest(range(8)) AS i) i")(lambda v: _six(pool.read_out(v.tokens, "gem", 1), "v"))
query("patch_tokens", BASE + " SELECT vec_id AS image_id, t.t AS pos, i.i AS dim, e[1 + t.t * 8 + i.i] AS v FROM emb, (SELECT unnest(range(2, 8)) AS t) t, (SELECT unnest(range(8)) AS i) i")(lambda v: pool.patch_tokens(v.tokens, 2, 6).select("image_id", "pos", "dim", "v"))
query("histograms", TF + ", w AS (SELECT DISTINCT word FROM book), h AS (SELECT vec_id AS image_id, w.word, coalesce(tf.tf, 0) AS n FROM emb CROSS JOIN w LEFT JOIN tf ON tf.image_id = vec_id AND tf.word = w.word) SELECT image_id, word, n FROM h")(
    lambda v: E.histograms(E.term_frequencies(_near(v)), v.every, v.spark.range(len(v.centers)).select(F.col("id").cast("int").alias("word"))).select("image_id", F.posexplode("counts").alias("word", "n"))
)
query("local_counts", LOCAL + " SELECT vec_id AS image_id, count(kp) AS n FROM emb LEFT JOIN loc ON image_id = vec_id GROUP BY 1")(lambda v: v.every.select(F.col("id").alias("image_id")).join(v.local().select("image_id", "kp"), "image_id", "left").groupBy("image_id").agg(F.count("kp").alias("n")))
# the grid of a map of 2 by 8 at two levels, by hand
WIDE = [(0, x, 2) for x in (0, 1, 2, 4, 5, 6)] + [(y, x, 1) for y in (0, 1) for x in (0, 1, 2, 4, 5, 6, 7)]
query("rmac_wide", f"""emb AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), cells AS (SELECT vec_id AS image_id, i.i // 16 AS c, (i.i % 16) // 8 AS y, i.i % 8 AS x, e[i.i + 1] AS v FROM emb, (SELECT unnest(range(64)) AS i) i),
grid(r, y0, x0, s) AS (VALUES {", ".join(f"({i}, {y}, {x}, {s})" for i, (y, x, s) in enumerate(WIDE))}), m AS (SELECT image_id, r, c, max(v) AS v FROM cells JOIN grid ON y >= y0 AND y < y0 + s AND x >= x0 AND x < x0 + s GROUP BY ALL),
n AS (SELECT *, greatest(sqrt(sum(v * v) OVER (PARTITION BY image_id, r)), 1e-6) AS n FROM m) SELECT image_id, c, round(sum(v / n), 6) AS v FROM n GROUP BY ALL""")(lambda v: _six(pool.rmac(v.wide_cells, 2, 8, 2), "v"))
query("multiscale_mac", CELLS + """, p AS (SELECT image_id, scale, c, max(v) AS v FROM cells GROUP BY ALL), u AS (SELECT image_id, scale, c, v / sqrt(sum(v * v) OVER (PARTITION BY image_id, scale)) AS v FROM p), g AS (SELECT image_id, c, avg(v) AS v FROM u GROUP BY ALL)
SELECT image_id, c, round(v / sqrt(sum(v * v) OVER (PARTITION BY image_id)), 6) AS v FROM g""")(lambda v: _six(pool.pool_scales(v.cells, None).withColumn("c", F.col("c").cast("long")), "v"))
query("knn_map", BASE + """, s AS (SELECT a.vec_id AS q, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) AS r FROM emb a JOIN emb b ON a.vec_id <> b.vec_id),
h AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY r)::DOUBLE / r AS p FROM s WHERE same) SELECT round(avg(ap), 6) AS mean_average_precision FROM (SELECT q, avg(p) AS ap FROM h GROUP BY 1)""")(lambda v: _six(mining.knn_average_precision(v.every, v.every), "mean_average_precision"))


def _rotated(v: Views) -> DataFrame:
    """Full-width components turn the centred vectors and keep their angles, whatever the signs."""
    turned = fit.pca_fit(v.every, 64).transform(v.every.select("id", "vec"))
    return search.scores(turned.filter("id % 10 = 0"), turned.filter("id % 10 != 0"), digits=5)


query("pca_angles", BASE + """, f AS (SELECT vec_id, i.i, e[i.i + 1] AS x FROM emb, (SELECT unnest(range(64)) AS i) i), m AS (SELECT i, avg(x) AS m FROM f GROUP BY 1), u AS (SELECT vec_id, list(x - m ORDER BY i) AS c FROM f JOIN m USING (i) GROUP BY 1)
SELECT a.vec_id AS query_id, b.vec_id AS image_id, round(list_cosine_similarity(a.c, b.c), 5) AS sim FROM u a JOIN u b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0""")(lambda v: _rotated(v))


def _white(v: Views) -> DataFrame:
    """Products of differences of matching pairs under the supervised projection: the unit matrix."""
    model = fit.supervised_whitening(v.every, _pairs(v))
    seen = fit.pair_differences(v.every, _pairs(v))
    turned = seen.withColumn("vec", F.transform(F.lit(model.components.tolist()), lambda row: V.dot(row, F.col("vec"))))
    return fit.gram(turned).select("i", "j", (F.round(F.col("g") / F.col("n"), 5) + 0.0).alias("g"))


query("whitened_pairs", "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END AS g FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j)")(_white)
