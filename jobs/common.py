"""What the jobs share: their command line, their settings and their log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("tidemark.jobs")


def settings(path: str | Path, required: set[str]) -> dict[str, Any]:
    """A small JSON object on the driver, with just the names that are required: part of the program, not of its data."""
    found = json.loads(Path(path).read_text())
    if set(found) != required:
        raise ValueError(f"{path}: expected {sorted(required)}, found {sorted(found)}")
    return found


def command_line(about: str, job: Callable[[SparkSession, argparse.Namespace], object], **paths: str) -> None:
    """Parses path arguments, creates the session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=name != "config", help=text)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about.split(".")[0]).getOrCreate()
    try:
        job(spark, args)
    finally:
        spark.stop()
