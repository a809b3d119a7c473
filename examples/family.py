"""What the examples share: a family's folder, an output folder, a session."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from quillon.session import session


def main(about: str, name: str, default: str, run: Callable, argv: list[str] | None = None) -> None:
    """Runs run(spark, folder, output, family) on <data-dir>/family_<family> and shows the metrics."""
    p = argparse.ArgumentParser(prog=f"python -m examples.{name}", description=about)
    p.add_argument("--family", default=default, help=f"a published family, {default} by default")
    p.add_argument("--data-dir", required=True, help="the folder of the families' folders")
    p.add_argument("--output-dir", help="where results go; outputs/<example>_family_<family> by default")
    a = p.parse_args(argv)
    output = a.output_dir or f"outputs/{name}_family_{a.family}"
    spark = session(f"quillon {name}")
    run(spark, f"{a.data_dir}/family_{a.family}", output, a.family)["metrics"].show(truncate=False, vertical=True)
    print(f"results: {output}")
