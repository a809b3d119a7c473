"""Names, paths and sizes as text, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(column: str | Column) -> Column:
    """True for true and for text that reads 'true' but for case and outer space; null is false."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def canonical_id(column: str | Column) -> Column:
    """Colons become underscores."""
    return F.translate(column, ":", "_")


def public_id(family: str | Column, number: str | Column) -> Column:
    """family<f>_seq<nnn>"""
    f = F.col(family) if isinstance(family, str) else family
    n = F.col(number) if isinstance(number, str) else number
    return F.format_string("family%s_seq%03d", f.cast("string"), n.cast("int"))


def safe_name(column: str | Column) -> Column:
    """File-name characters; all others become underscores."""
    return F.regexp_replace(column, "[^A-Za-z0-9_.-]", "_")


def subject_cluster(column: str | Column) -> Column:
    """The whole number after the last bar of a subject's name, null if there is none."""
    return F.element_at(F.split(column, r"\|"), -1).try_cast("int")


def path_label(path: str | Column, empty: str = "root") -> Column:
    """A node's path as text; `empty` for the path of no steps."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(F.size(p) == 0, F.lit(empty)).otherwise(F.array_join(p.cast("array<string>"), "-"))


def child_sizes(sizes: str | Column) -> Column:
    """label:size pairs of a map in order of label, null for an empty one."""
    m = F.col(sizes) if isinstance(sizes, str) else sizes
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return F.when(F.size(m) > 0, F.array_join(pairs, ";"))
