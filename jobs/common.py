"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

HERE = os.path.dirname(os.path.abspath(__file__))


def config_of(name: str, path: str | None = None) -> dict:
    """The settings in a small file of JSON: the one beside the job, unless another is named. A name that the job's own file lacks is an error."""
    with open(os.path.join(HERE, f"{name}.json"), encoding="utf-8") as f:
        out = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if unknown := set(given) - set(out):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out |= given
    return out


def command_line(name: str, paths: dict[str, str], run: Callable) -> None:
    """Parse one argument for each of paths (name: help) and --config, start a session, run, stop."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for p, said in paths.items():
        parser.add_argument(f"--{p}", required=True, help=said)
    parser.add_argument("--config", help="a file of JSON with settings that differ from the job's own")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from gleanstone.session import session

    spark = session(name)
    try:
        run(spark, **{p: getattr(given, p) for p in paths}, config=config_of(name, given.config))
    finally:
        spark.stop()
