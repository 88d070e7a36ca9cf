"""python -m pairlight audit|evaluate|single|train|describe: runs over Parquet tables."""

from __future__ import annotations

import argparse

from pairlight import pipeline
from pairlight.config import Settings, load, with_overrides


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="pairlight")
    parser.add_argument("stage", choices=["audit", "evaluate", "single", "train", "describe"])
    parser.add_argument("--predictions", help="Parquet of predictions (for train: distillation outputs)")
    parser.add_argument("--repair", help="Parquet of repair outputs")
    parser.add_argument("--cache", help="Parquet of cached scores")
    parser.add_argument("--model-a", help="model id of run A")
    parser.add_argument("--model-b", help="model id of run B")
    parser.add_argument("--order", default="delivery_id", help="columns that order rows, separated by commas")
    parser.add_argument("--policy", action="append", help="policies to take (audit, evaluate, single); all if none")
    parser.add_argument("--cap", type=int, help="at most so many pairs, the first by key (audit, evaluate)")
    parser.add_argument("--out", help="folder of the description of --predictions as samples (describe)")
    parser.add_argument("--config")
    parser.add_argument("--override", action="append", default=[], metavar="a.b=value")
    opts = parser.parse_args(args)
    settings = with_overrides(load(opts.config) if opts.config else Settings(), opts.override)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"pairlight-{opts.stage}").getOrCreate()
    rows = spark.read.parquet(opts.predictions)
    if opts.stage == "audit":
        out = pipeline.run_audit(rows, spark.read.parquet(opts.cache), opts.model_a, opts.model_b, settings, policies=opts.policy, cap=opts.cap)
    elif opts.stage == "evaluate":
        out = pipeline.run_evaluation(rows, opts.model_a, opts.model_b, settings, policies=opts.policy, cap=opts.cap)
    elif opts.stage == "single":
        out = pipeline.run_single_evaluation(rows, opts.model_a, settings, policies=opts.policy)
    elif opts.stage == "describe":
        out = pipeline.describe_samples(rows, opts.out)
    else:
        out = pipeline.prepare_training(rows, spark.read.parquet(opts.repair), opts.order.split(","), settings)
    print(out)
    return str(out)


if __name__ == "__main__":
    main()
