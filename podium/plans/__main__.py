"""The lecture pipeline from a shell: python -m podium.plans TABLES STORE [settings].

TABLES is a folder with frames, words and ocr (and figures, if there are any) as Parquet; each stage's result goes to STORE under its name, and
--skip_to begins at a later stage with what is stored there. A setting left out has the value that --config has, else its default. Learned
models are functions, so what needs one is run from Python (`lecture_stages(models=...)`).
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from podium.plans.pipeline import CHOICES, Config, Pipeline, lecture_stages
from podium.session import build_session


def parser() -> argparse.ArgumentParser:
    """One option for each field of the configuration."""
    out = argparse.ArgumentParser(prog="podium.plans", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("tables", help="folder of the input tables")
    out.add_argument("store", help="folder of the results")
    out.add_argument("--config", help="JSON file of settings")
    out.add_argument("--lecture_column", default="lecture_id", help="column that tells lectures apart")
    out.add_argument("--master", help="Spark's master, where no cluster sets it")
    for field in dataclasses.fields(Config):
        kind = {"nargs": "+", "type": str} if isinstance(field.default, tuple) else {"type": type(field.default)}
        out.add_argument(f"--{field.name}", choices=CHOICES.get(field.name), default=None, help=f"default: {field.default}", **kind)
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, float]:
    """Runs the pipeline and gives the seconds of each stage, which are also printed as JSON."""
    given = parser().parse_args(args)
    told = {f.name: v for f in dataclasses.fields(Config) if (v := getattr(given, f.name)) is not None}
    if "summarization_mods" in told:
        told["summarization_mods"] = tuple(told["summarization_mods"])
    config = Config.of(given.config, **told)
    if config.summarization_abs != "none" or config.structured_method != "none":
        parser().error("summaries by a learned model need one: call lecture_stages with models")
    spark = spark or build_session("podium", master=given.master)
    read = lambda name: spark.read.parquet(f"{given.tables.rstrip('/')}/{name}.parquet")
    try:
        figures = read("figures")
    except AnalysisException:
        figures = None
    run = Pipeline(spark, lecture_stages(read("frames"), read("words"), read("ocr"), figures, given.lecture_column), config, given.store)
    run.run_all()
    print(json.dumps({k: round(v, 3) for k, v in run.seconds.items()}))
    return run.seconds


if __name__ == "__main__":
    main(sys.argv[1:])
