"""Corpus pipeline: toxicity, n-gram Jaccard join, secret scans, mixing, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of documents and returns what it
keeps of them; the last returns the bins. ``run`` writes each stage's rows to the shared
folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsieve.llm.jaccard import ngram_jaccard_join
from vecsieve.llm.mixing import mix_sources
from vecsieve.llm.packing import best_fit_pack
from vecsieve.llm.secrets import scan_secrets
from vecsieve.llm.store import Cuts
from vecsieve.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CHUNK = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with ``_row``, unique and ordered as ids are: the ids, or, if one repeats or is null, numbers written once."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    order = [F.col(c).asc_nulls_first() for c in COLUMNS]
    return Cuts(spark).cut(docs.select(*COLUMNS).orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carry=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    rows = numbered(spark, docs)
    groups = ngram_jaccard_join(rows, id_col="_row")
    first = groups.filter("_row = component_id").select("_row")
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    out = scan_secrets(docs, carry=["lang", "source", "n_chars"]).withColumnRenamed("redacted", "text")
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last time, its first words only if it takes no more."""
    rows = numbered(spark, docs)
    plan = mix_sources(rows, id_col="_row").select("_row", "size", "taken").filter("taken > 0")
    out = rows.join(plan, "_row")
    times = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))
    out = out.withColumn("_time", F.explode(times)).withColumn("_words", F.col("taken") - (F.col("_time") - 1) * F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("_words") < F.col("size"), part).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins."""
    return best_fit_pack(docs)


STAGES = [("toxicity", not_toxic), ("ngram_jaccard_join", one_of_each), ("secret_scans", no_secrets), ("mixing", mixed), ("best_fit_packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cuts.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
