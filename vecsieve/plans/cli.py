"""Command line: ``python -m vecsieve.plans.cli download|evaluate|results|presets|track|train|whiten``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from ..operators import fit
from ..session import local_session
from ..sources import runlog, tables, tracking
from . import config, runner, views


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vecsieve")
    sub = out.add_subparsers(dest="command", required=True)
    d = sub.add_parser("download", help="copy datasets' descriptor tables, images counted")
    d.add_argument("datasets", nargs="+", choices=[*sorted(config.HELD_OUT), "all"])
    d.add_argument("--source", required=True, help="folder with a table of images and one of queries per dataset")
    d.add_argument("--out", required=True)
    e = sub.add_parser("evaluate", help="rank, score and record a technique or preset over descriptor tables")
    e.add_argument("technique")
    e.add_argument("--tables", required=True, help="folder with embeddings.parquet")
    e.add_argument("--dataset", default="roxford5k", choices=sorted(config.HELD_OUT))
    e.add_argument("--mp-at-k", type=int, default=10)
    e.add_argument("--sweep", type=int, nargs="*", default=[])
    e.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    e.add_argument("--log")
    e.add_argument("--cache", help="folder of descriptors, vocabularies and mixtures that are made once")
    e.add_argument("--whitening", help="folder that the whiten command wrote")
    r = sub.add_parser("results", help="show the log")
    r.add_argument("log")
    r.add_argument("--dataset")
    r.add_argument("--technique")
    r.add_argument("--metric", default="map", choices=["map", "mp_at_k"])
    r.add_argument("--current-only", action="store_true")
    t = sub.add_parser("track", help="replay the log into a derived store")
    t.add_argument("log")
    t.add_argument("store")
    t.add_argument("--current-only", action="store_true")
    w = sub.add_parser("whiten", help="learn whitening from descriptors and matching pairs")
    w.add_argument("--vectors", required=True, help="folder of (id, vec) at one scale")
    w.add_argument("--multi-scale", help="folder of (id, vec) at several scales")
    w.add_argument("--pairs-table", required=True, help="folder of (pair_id, q, p)")
    w.add_argument("--pairs", type=int, default=20000)
    w.add_argument("--seed", type=int, default=0)
    w.add_argument("--out", required=True)
    sub.add_parser("train", help="needs a network; see plans.training.train")
    sub.add_parser("presets", help="list presets")
    return out


def download(spark, a: argparse.Namespace) -> int:
    for name in sorted(config.HELD_OUT) if "all" in a.datasets else a.datasets:
        for part, count in zip(("images", "queries"), config.SIZES[name]):
            tables.checked(spark.read.parquet(f"{a.source}/{name}/{part}"), count).write.mode("overwrite").parquet(f"{a.out}/{name}/{part}")
        print(f"{name}: {config.SIZES[name][0]} images, {config.SIZES[name][1]} queries")
    return 0


def evaluate(spark, a: argparse.Namespace) -> int:
    run = config.Run(config.from_options(a.technique, dict(x.split("=", 1) for x in a.set)), a.dataset, a.mp_at_k)
    store = tables.Store(spark, a.cache) if a.cache else None
    learned = runner.attached(spark, a.whitening) if a.whitening else None
    records = runner.run_all(spark, config.sweep(run, tuple(a.sweep)), lambda x: views.inputs(spark, a.tables, x, store, learned), a.log, store)
    for record in records:
        print(record.technique, record.params, record.metrics)
    return 0


def results(spark, a: argparse.Namespace) -> int:
    records = runlog.load(spark, a.log) if tables.found(spark, a.log) else None
    if records is None:
        print("no runs recorded yet")
        return 0
    shown = runlog.show(records, a.dataset, a.technique, a.metric, a.current_only)
    said = runlog.message(records, shown)
    print(said or runlog.render([r.asDict() for r in shown.collect()], shown.columns))
    return 0


def track(spark, a: argparse.Namespace) -> int:
    records = runlog.load(spark, a.log)
    print(tracking.replay(runlog.current(records) if a.current_only else records, a.store), "runs")
    return 0


def whiten(spark, a: argparse.Namespace) -> int:
    pairs = spark.read.parquet(a.pairs_table)
    pairs = fit.seeded_sample(pairs, "pair_id", a.pairs, a.seed).select("q", "p")
    sides = {"ss": a.vectors, "ms": a.multi_scale or a.vectors}
    vectors = {k: spark.read.parquet(p).select("id", F.col("vec").cast("array<double>").alias("vec")) for k, p in sides.items()}
    runner.attach(spark, a.out, runner.learn_whitening(vectors, pairs))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "presets":
        for name, d in config.PRESETS.items():
            print(name, config.params(d))
        return 0
    if a.command == "train":
        print("training needs a network that is not part of this library: call plans.training.train with its functions", file=sys.stderr)
        return 2
    return {"download": download, "evaluate": evaluate, "results": results, "track": track, "whiten": whiten}[a.command](local_session(), a)


if __name__ == "__main__":
    sys.exit(main())
