"""Append-only run log: JSON lines, one file per append, a dynamic ``params`` map kept as JSON text."""

from __future__ import annotations

import json
import subprocess
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRIC = "struct<map:double,mp_at_k:double,k:int,num_queries:int,num_excluded:int>"
FIELDS = ["dataset", "held_out_dataset", "technique", "params", "metrics", "seconds", "commit", "recorded_at"]
SCHEMA = f"dataset string, held_out_dataset string, technique string, params string, metrics map<string,{METRIC}>, seconds double, commit string, recorded_at string"
DISPLAY = ["easy", "medium", "hard"]
# Descriptor widths by backbone and by model.
CHANNELS = {"alexnet": 256, "vgg16": 512, "vgg19": 512, "resnet18": 512, "resnet34": 512, "resnet50": 2048, "resnet101": 2048}
VIT_WIDTHS = {
    "dinov2-vits14": 384,
    "dinov2-vitb14": 768,
    "dinov2-vitl14": 1024,
    "dinov2-vitg14": 1536,
    "dinov3-vits16": 384,
    "dinov3-vitb16": 768,
    "dinov3-vitl16": 1024,
    "siglip2-vitl16-256": 1024,
    "siglip2-vitl16-384": 1024,
    "siglip2-vitl16-512": 1024,
    "deit-vits16-dist-224": 384,
    "deit-vitb16-dist-224": 768,
    "deit-vitb16-dist-384": 768,
}


def git_commit() -> str | None:
    """The current commit; None where there is none."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


@dataclass(frozen=True)
class RunRecord:
    dataset: str
    held_out_dataset: str
    technique: str
    params: dict
    metrics: dict[str, dict]
    seconds: float | None = None
    commit: str | None = field(default_factory=git_commit)
    recorded_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat(timespec="seconds"))

    @property
    def key(self) -> tuple[str, str, str]:
        return self.dataset, self.technique, json.dumps(self.params, sort_keys=True)


def append(spark: SparkSession, record: RunRecord, path: str) -> None:
    """One more line in a file of its own, numbered after those that are there; nothing written before is touched."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    place = len(files.listStatus(folder))
    while True:
        out = jvm.org.apache.hadoop.fs.Path(folder, f"{place:012d}.jsonl")
        try:
            stream = files.create(out, False)
        except Exception:
            if not files.exists(out):
                raise
            place += 1  # another writer took the number
            continue
        stream.write((json.dumps(asdict(record)) + "\n").encode())
        stream.close()
        return


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, seq)`` in the order of the files' names, which are numbers, and of their lines."""
    meta = F.col("_metadata")
    text = spark.read.text(path).select("value", meta["file_name"].alias("f"), meta["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("i"))
    return text.filter("value != ''").select("value", F.struct("f", "b", "i").alias("seq"))


def load(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records with ``seq``. Strict: a line with an unknown field, or no object, is an error."""
    raw = lines(spark, path)
    odd = F.array_except(F.coalesce(F.json_object_keys("value"), F.array(F.lit("no object"))), F.array(*map(F.lit, FIELDS)))
    if strict:
        sure = F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(odd, ", ")))).otherwise(F.col("value"))
        raw = raw.withColumn("value", sure.cast("string"))
    parsed = F.from_json("value", SCHEMA, {"allowNonNumericNumbers": "true"})
    return raw.select("seq", parsed.alias("r"), F.get_json_object("value", "$.params").alias("p")).select("seq", "r.*", "p").withColumn("params", F.col("p")).drop("p")


def params_map(params: Column) -> Column:
    return F.from_json(params, "map<string,string>")


def canonical(params: Column) -> Column:
    """JSON text with keys in order and each value in its original text: 1, 1.0 and "1" are three values."""
    one = lambda k: F.concat(F.lit('"'), k, F.lit('": '), raw_value(params, k))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.json_object_keys(params)), one), ", "), F.lit("}"))


def raw_value(params: Column, key: Column) -> Column:
    """The original text of a key's value."""
    text = F.element_at(F.regexp_extract_all(params, F.concat(F.lit('"'), key, F.lit(r'"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^,}\s]+)')), F.lit(1)), 1)
    return F.regexp_replace(text, r",\s+", ", ")


def latest(records: DataFrame, key: list[Column], seq: str = "seq") -> DataFrame:
    """The last record of each key by position in the log."""
    named = records.withColumns({f"_k{i}": c for i, c in enumerate(key)})
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(F.col(seq).desc())
    return named.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", *[f"_k{i}" for i in range(len(key))])


def current(records: DataFrame) -> DataFrame:
    return latest(records, [F.col("dataset"), F.col("technique"), canonical(F.col("params"))])


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def descriptor_dim(technique: Column, params: Column) -> Column:
    """Width of the descriptor; null where it is not known."""
    get = lambda name: F.try_element_at(params, F.lit(name))
    k, dim = get("k").try_cast("int"), get("dim").try_cast("int")
    return (
        F.when(technique == "bow", k).when(technique == "vlad", 128 * k).when(technique == "fisher", 256 * k)
        .when(technique == "neural_codes", F.coalesce(dim, F.lit(4096)))
        .when(technique.isin("gem", "rmac"), F.coalesce(dim, _lookup(CHANNELS, get("backbone"))))
        .when(technique == "vit", F.coalesce(dim, _lookup(VIT_WIDTHS, get("model"))))
    )


def tidy(records: DataFrame) -> DataFrame:
    """One row per run and protocol, protocols in alphabetical order."""
    params = params_map(F.col("params"))
    one = records.select("*", F.explode(F.array_sort(F.map_entries("metrics"))).alias("m"))
    return one.select("dataset", "held_out_dataset", "technique", params.alias("params"), F.col("m.key").alias("protocol"), "m.value.*", descriptor_dim(F.col("technique"), params).alias("dim"), "seconds", "commit", "recorded_at")


def flatten_metrics(records: DataFrame) -> DataFrame:
    """``metrics`` as one map of protocol/metric, seconds only where present."""
    each = F.transform(F.map_entries("metrics"), lambda e: F.array(*[F.struct(F.concat(e["key"], F.lit(f"/{m}")).alias("key"), e["value"][m].cast("double").alias("value")) for m in ("map", "mp_at_k", "k", "num_queries", "num_excluded")]))
    seconds = F.when(F.col("seconds").isNotNull(), F.array(F.struct(F.lit("seconds").alias("key"), F.col("seconds").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:double>>"))
    return records.withColumn("metrics", F.map_from_entries(F.concat(F.flatten(each), seconds)))


def config_of(records: DataFrame) -> DataFrame:
    """``config``: all that determines a run, as text; a parameter wins over a column of its name."""
    base = F.create_map(*[x for c in ("dataset", "held_out_dataset", "technique", "commit") for x in (F.lit(c), F.col(c))])
    own = params_map(F.col("params"))
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return records.withColumn("config", F.map_concat(kept, own))


def first_seen(records: DataFrame, key: list[Column], seq: str = "seq") -> DataFrame:
    """The last record of each key, with ``place``: keys in the order in which they first came."""
    named = records.withColumns({f"_k{i}": c for i, c in enumerate(key)})
    names = [f"_k{i}" for i in range(len(key))]
    rest = F.struct(*[F.col(c) for c in records.columns])
    best = named.groupBy(*names).agg(F.max_by(rest, F.col(seq)).alias("r"), F.min(seq).alias("_first"))
    place = F.row_number().over(Window.orderBy("_first")) - 1
    return best.withColumn("place", place.cast("long")).select("r.*", "place")


def display_order(df: DataFrame) -> DataFrame:
    """By dataset, technique, k as an integer (0 if none), params text, time."""
    return df.orderBy("dataset", "technique", F.coalesce(F.get_json_object("params", "$.k").try_cast("int"), F.lit(0)), "params", "recorded_at")


def show(records: DataFrame, dataset: str | None = None, technique: str | None = None, metric: str = "map", current_only: bool = False) -> DataFrame:
    """The table of the results command; an absent metric is a dash. No record at all and none that matches are told apart by ``message``."""
    out = current(records) if current_only else records
    out = out.filter(F.col("dataset") == dataset) if dataset else out
    out = out.filter(F.col("technique") == technique) if technique else out
    cell = lambda p: F.coalesce(F.format_string("%.4f", F.try_element_at("metrics", F.lit(p))[metric]), F.lit("-")).alias(p)
    return display_order(out).select("dataset", "technique", "params", *map(cell, DISPLAY), F.left("recorded_at", F.lit(10)).alias("date"))


def message(records: DataFrame, shown: DataFrame) -> str | None:
    """What to say where nothing is shown: an empty store and a filter that nothing passes are different."""
    if not shown.isEmpty():
        return None
    n = records.count()
    return f"no runs match that filter ({n} recorded)" if n else "no runs recorded yet"


def render(rows: list[dict], headers: list[str]) -> str:
    """Rows as a table of fixed width."""
    cells = [headers, *[[str(r[h]) for h in headers] for r in rows]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(headers))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, widths)).rstrip() for c in cells)
