"""What the jobs share: their command line, and documents as files."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def as_files(docs: DataFrame) -> DataFrame:
    """Add path, source/lang/doc_id; a null part is written as ``none``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return docs.withColumn("path", F.concat_ws("/", part("source"), part("lang"), part("doc_id")))


def main(run: Callable[..., object], name: str, required: list[str]) -> None:
    """Read the config file, take options that replace its values, and run the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON file of the job's arguments")
    given_config, rest = parser.parse_known_args()
    config = json.loads(Path(given_config.config).read_text())
    for key, value in config.items():
        parser.add_argument(f"--{key.replace('_', '-')}", default=value, type=type(value) if value is not None else str)
    given = {k: v for k, v in vars(parser.parse_args()).items() if k != "config"}
    missing = [k for k in required if not given.get(k)]
    if missing:
        parser.error(f"these must be given, in the config file or as options: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **given)
    finally:
        spark.stop()


if __name__ == "__main__":
    raise SystemExit("run one of the jobs: python -m jobs.ingest, python -m jobs.navigate")
