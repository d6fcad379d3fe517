"""What the jobs' command lines share: a config file, a session that is made and stopped here only, and logging."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """The defaults, overridden by a JSON object that Spark reads; a key that no default names is an error."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = sorted(set(found) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | found


def main(job: Callable[..., DataFrame], paths: list[str], defaults: dict, doc: str, argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=doc.splitlines()[0])
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help="a path that Spark can open")
    parser.add_argument("--config", default=str(Path(sys.modules[job.__module__].__file__).with_suffix(".json")), help="a JSON object of settings")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(job.__module__.rsplit(".", 1)[-1]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = read_config(spark, args.pop("config"), defaults)
        job(spark, *[args[p] for p in paths], config)
    finally:
        spark.stop()
