"""Views of the driver's tables as descriptor tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import Mixture
from ..sources.tables import Store
from .config import Bow, Fisher, Run, Vlad

WIDTH, PARTS = 8, 8
PAIRS_OF_A_TASK = 5_000_000
MODELS = ("dinov2-vits14", "deit-vitb16-dist-224", "siglip2-vitl16-384")
CHECKPOINT = "runs/deit-vitb16-dist-224-lr1e-05-lora8-seed0/best.pth"


def grades(q: int, ids: np.ndarray) -> np.ndarray:
    """The rule of ``Views.truth`` for items with the query's label."""
    rest = np.fmod(ids, 3)
    return np.where(rest == 0, 3 if q % 70 == 0 else 1, np.where(rest == 1, 2, 3))


class Views:
    """Deterministic views over ``embeddings``: global and local descriptors, truth, codebook, mixture."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        e = self.table("embeddings")
        self.every = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
        self.queries = self.every.filter("id % 10 = 0")
        self.database = self.every.filter("id % 10 != 0")
        self.query_ids = self.queries.select(F.col("id").alias("query_id"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def truth(self) -> DataFrame:
        """``(query_id, image_id, grade)``, each pair once. A label's pairs are spread over slices of the database, as many as there are pairs to make."""
        q = self.queries.select(F.col("id").alias("query_id"), "label").distinct()
        d = self.database.select(F.col("id").alias("image_id"), "label").distinct()
        number = max(2 * self.spark.sparkContext.defaultParallelism, min(512, q.count() * d.count() // PAIRS_OF_A_TASK))
        d = d.withColumn("_s", F.pmod(F.xxhash64("image_id"), F.lit(number)).cast("int")).repartition(number, "label", "_s")
        q = q.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).repartition(number, "label", "_s")
        base = F.when(F.col("image_id") % 3 == 0, F.when(F.col("query_id") % 70 == 0, "junk").otherwise("easy")).when(F.col("image_id") % 3 == 1, "hard").otherwise("junk")
        pairs = q.join(d.hint("merge"), ["label", "_s"]).select("query_id", "image_id", base.alias("grade"))
        several = self.every.groupBy("id").agg((F.min("label") != F.max("label")).alias("several")).filter("several")
        return pairs if several.isEmpty() else pairs.distinct()

    def local(self, rows: DataFrame | None = None) -> DataFrame:
        """``(image_id, kp, vec, label)``: sub-vectors 0 up to id mod 9."""
        rows = self.every if rows is None else rows
        kept = rows.withColumn("kp", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).filter(F.col("kp") < F.col("id") % 9)
        return kept.select(F.col("id").alias("image_id"), "kp", F.slice("vec", F.col("kp") * WIDTH + 1, F.lit(WIDTH)).alias("vec"), "label")

    @property
    def cells(self) -> DataFrame:
        """``(image_id, scale, c, y, x, v)``: 4 channels of 4 by 4; scale 1 keeps every second row and column."""
        long = self.every.select(F.col("id").alias("image_id"), F.posexplode("vec").alias("i", "v"))
        long = long.select("image_id", F.floor(F.col("i") / 16).cast("int").alias("c"), F.floor(F.col("i") % 16 / 4).cast("int").alias("y"), (F.col("i") % 4).alias("x"), "v")
        half = long.filter("x % 2 = 0 and y % 2 = 0")
        return long.withColumn("scale", F.lit(0)).unionByName(half.withColumn("scale", F.lit(1)))

    @property
    def wide_cells(self) -> DataFrame:
        """``(image_id, c, y, x, v)``: 4 channels of 2 rows by 8 columns."""
        long = self.every.select(F.col("id").alias("image_id"), F.posexplode("vec").alias("i", "v"))
        return long.select("image_id", F.floor(F.col("i") / 16).alias("c"), F.floor(F.col("i") % 16 / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")

    @property
    def tokens(self) -> DataFrame:
        """``(image_id, pos, dim, v)``: 8 tokens of 8 values."""
        long = self.every.select(F.col("id").alias("image_id"), F.posexplode("vec").alias("i", "v"))
        return long.select("image_id", F.floor(F.col("i") / 8).alias("pos"), (F.col("i") % 8).cast("long").alias("dim"), "v")

    @property
    def records(self) -> DataFrame:
        """``events`` as run records with ``seq``, the columns of the run log's schema."""
        n, v = F.col("event_id"), F.col("value")
        pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
        text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
        vit = text('{"model": "', pick(MODELS, n), '", "image_size": ', F.when(n % 4 == 0, 518).otherwise(224), ', "whiten": ', F.when(n % 6 == 0, "true").otherwise("false"), F.when(n % 7 == 0, f', "checkpoint": "{CHECKPOINT}"').otherwise(""), "}")
        gem = text('{"backbone": "', pick(("vgg16", "resnet101"), n), '", "scales": [1.0, 0.7071067811865476], "p": 3.0, "lr": 5e-07}')
        plain = text('{"seed": 0, "k": ', F.get_json_object("props", "$.k"), "}")
        technique = pick(("bow", "vlad", "fisher", "gem", "vit"), n)
        metric = lambda share: F.struct((v * share).alias("map"), v.alias("mp_at_k"), F.lit(10).alias("k"), F.lit(70).alias("num_queries"), F.lit(0).alias("num_excluded"))
        even = F.col("user_id") % 2 == 0
        return self.table("events").select(
            n.alias("seq"), F.when(even, "roxford5k").otherwise("rparis6k").alias("dataset"), F.when(even, "rparis6k").otherwise("roxford5k").alias("held_out_dataset"), technique.alias("technique"),
            F.when(technique == "vit", vit).when(technique == "gem", gem).otherwise(plain).alias("params"), F.create_map(F.lit("medium"), metric(0.75), F.lit("hard"), metric(0.5), F.lit("easy"), metric(1.0)).alias("metrics"),
            F.when(n % 2 == 0, v).alias("seconds"), text("c", n % 3).alias("commit"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("recorded_at"),
        )

    def _groups(self) -> list:
        held = self.local(self.every.filter("id % 2 = 1")).select("label", "image_id", "kp", F.posexplode("vec").alias("dim", "x"))
        mean = held.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
        return mean.orderBy("label", "dim").collect()

    @property
    def centers(self) -> np.ndarray:
        """One word per label: the mean held-out sub-vector."""
        return np.array([r["m"] for r in self._groups()]).reshape(-1, WIDTH)

    @property
    def mixture(self) -> Mixture:
        rows = self._groups()
        shape = lambda k: np.array([r[k] for r in rows], float).reshape(-1, WIDTH)
        n = shape("n")[:, 0]
        return Mixture(n / n.sum(), shape("m"), shape("v"))


def inputs(spark: SparkSession, folder: str, run: Run, store: Store | None = None, learned: dict | None = None):
    """Inputs of a run from an embeddings table: odd ids are held out. With a store, local descriptors are made once per dataset and role."""
    from .runner import Inputs

    v = Views(spark, folder)
    local = isinstance(run.descriptor, Bow | Vlad | Fisher)

    def pick(rows: DataFrame, role: str) -> DataFrame:
        if not local:
            return rows
        make = lambda: v.local(rows)
        return make() if store is None else store.get("rootsift", make, dataset=run.dataset, role=role)

    held = v.every.filter("id % 2 = 1")
    return Inputs(pick(held, "held_out"), pick(v.database, "database"), pick(v.queries, "queries"), v.database.select("id"), v.queries.select("id"), v.truth, learned)
