"""Reading a job's configuration and starting its session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from gaugelake.session import build_session


def load(spark: SparkSession, path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """``defaults`` with what the JSON file at ``path`` sets, read by Spark: the path may be remote. An unknown name is an error."""
    given = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if path else {}  # one small file
    if unknown := sorted(set(given).difference(defaults)):
        raise ValueError(f"unknown settings: {unknown}")
    return defaults | given


def main(run: Callable, defaults: dict[str, Any], what: str, paths: dict[str, str], argv: list[str] | None = None) -> None:
    """The command line of a job: its paths, ``--config`` and ``--master``. Starts the session, runs the job, stops the session."""
    parser = argparse.ArgumentParser(description=what)
    for name, told in paths.items():
        parser.add_argument(f"--{name}", required=True, help=told)
    parser.add_argument("--config", help="a JSON file with settings")
    parser.add_argument("--master", help="the cluster's address; without it that of spark-submit, or this machine")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    # Without --master a session that spark-submit has set up keeps its settings.
    spark = build_session(args.master, what) if args.master else SparkSession.builder.appName(what).getOrCreate()
    try:
        run(spark, *[getattr(args, name) for name in paths], config=load(spark, args.config, defaults))
    finally:
        spark.stop()
