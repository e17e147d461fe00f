"""What the jobs share: config files, logging and sessions of the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def load_config(path: str | Path, kind: type):
    """The settings of a JSON file as ``kind``, a dataclass; unknown ones are an
    error."""
    return kind(**json.loads(Path(path).read_text()))


def command_line(doc: str, names: dict[str, str], config: Path, work: Callable[[SparkSession, argparse.Namespace], None]) -> None:
    """Parse ``--name`` paths (name: help) and ``--config``, run ``work`` in a
    session of its own, and stop that session."""
    parser = argparse.ArgumentParser(description=doc.split("\n", 1)[0])
    for name, told in names.items():
        parser.add_argument(f"--{name}", required=True, help=told)
    parser.add_argument("--config", default=str(config), help=f"settings, default {config.name}")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(config.stem).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, given)
    finally:
        spark.stop()
