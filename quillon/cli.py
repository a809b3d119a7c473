"""quick-start, recursive, fixed-binary, evaluate, prepare-example and verify-example from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quillon.session import session

FOLDERS = ["matrix", "annotation", "sequence", "tree", "dbscan", "umap", "spectral", "recursive_k2", "recursive_silhouette"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    kinds = p.add_subparsers(dest="command", required=True)
    for name in ("quick-start", "recursive", "fixed-binary"):
        k = kinds.add_parser(name)
        k.add_argument("--mldist", "--distance", dest="distance", required=True, help="distance file, or a glob of them")
        k.add_argument("--labels", required=True)
        k.add_argument("--output-dir", "--output", dest="output", required=True)
        k.add_argument("--family", default="family", help="name of the family; '' for files of many, each named by its stem")
        if name == "quick-start":
            continue
        k.add_argument("--alignment", required=True)
        # scores come from Spark tasks, not from programs with threads and files of their own
        k.add_argument("--swipe-threads", type=int, default=2, help="accepted, has no effect")
        k.add_argument("--temporary-parent", help="accepted, has no effect")
    for name in ("prepare-example", "verify-example"):
        k = kinds.add_parser(name)
        for f in ("family", "distance", "alignment", "annotation", "output" if name == "prepare-example" else "public"):
            k.add_argument(f"--{f}", required=True)
        if name == "prepare-example":
            k.add_argument("--facts", help="a JSON file of what is known of the family: organism, assembly, sources; goes into its metadata")
    k = kinds.add_parser("evaluate")
    for f in FOLDERS:
        k.add_argument(f"--{f.replace('_', '-')}-dir", f"--{f.replace('_', '-')}", dest=f, required=True)
    k.add_argument("--family-metadata", required=True)
    k.add_argument("--expected-family-count", "--expected-families", dest="expected_families", type=int)
    k.add_argument("--family-output", help="the table of families, a CSV file")
    k.add_argument("--method-output", help="the table of methods, a CSV file")
    k.add_argument("--output", help="a folder for both")
    return p


def read_facts(spark: SparkSession, path: str) -> dict:
    """The object of a JSON file, wherever Spark can read it."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def main(argv: list[str] | None = None) -> int:
    from quillon.plans import dataset, publish, workflows

    a = parser().parse_args(argv)
    spark = session("quillon-cli")
    if a.command == "quick-start":
        workflows.run_quick_start(spark, a.distance, a.labels, a.output, a.family or None)
    elif a.command == "recursive":
        workflows.run_full_recursive(spark, a.distance, a.alignment, a.labels, a.output, a.family or None)
    elif a.command == "fixed-binary":
        workflows.run_fixed_binary_baseline(spark, a.distance, a.alignment, a.labels, a.output, a.family or None)
    elif a.command == "prepare-example":
        publish.prepare_example(spark, a.family, a.distance, a.alignment, a.annotation, a.output, facts=read_facts(spark, a.facts) if a.facts else None)
    elif a.command == "verify-example":
        publish.verify_example(spark, a.family, a.distance, a.alignment, a.annotation, a.public)
        print(f"family {a.family}: only the names differ")
    else:
        if not a.output and not (a.family_output and a.method_output):
            parser().error("evaluate needs --family-output and --method-output, or --output")
        dataset.evaluate_dataset(spark, {f: getattr(a, f) for f in [*FOLDERS, "family_metadata"]}, a.output, a.expected_families, a.family_output, a.method_output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
