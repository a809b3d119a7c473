"""What the jobs' command lines share: a config file, options that override it, a session from start to end."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from quillon.session import session


def main(name: str, about: str, run: Callable, paths: tuple[str, ...], argv: list[str] | None = None) -> None:
    """Runs run(spark, **config): the config file's items, with those paths that are given as options."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    p.add_argument("--config", required=True, help="a JSON file of the job's parameters")
    for path in paths:
        p.add_argument(f"--{path}", help=f"path, in place of the config's {path}")
    given = vars(p.parse_args(argv))
    with open(given.pop("config"), encoding="utf-8") as f:
        config = json.load(f)
    config |= {k: v for k, v in given.items() if v is not None}
    lost = [x for x in paths if x not in config]
    if lost:
        p.error(f"neither an option nor the config names {', '.join(lost)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(f"quillon {name}")
    try:
        run(spark, **config)
    finally:
        spark.stop()
