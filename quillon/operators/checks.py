"""Integrity rules as queries: each gives the rows that break it, and fail_on raises if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.numbering import BROADCAST_ROWS
from quillon.session import settled


def fail_on(broken: DataFrame, message: str, show: int = 5) -> None:
    """Raises ValueError with the first rows if there are any."""
    rows = broken.limit(show).collect()
    if rows:
        raise ValueError(f"{message}: {[r[0] if len(r) == 1 else tuple(r) for r in rows]}")


def duplicate_ids(ids: DataFrame, *keys: str) -> DataFrame:
    return ids.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def blank_ids(ids: DataFrame, column: str) -> DataFrame:
    return ids.filter(F.trim(F.col(column)) == "")


def validate_ids(ids: DataFrame, column: str = "sequence_id", name: str = "table", family: list[str] | None = None) -> None:
    """Some ids, each once, none blank; in this order."""
    keys = [*(family or []), column]
    if ids.isEmpty():
        raise ValueError(f"{name} contains no sequence IDs")
    fail_on(duplicate_ids(ids, *keys).select(column), f"{name} contains duplicate sequence IDs")
    fail_on(blank_ids(ids, column).select(*keys), f"{name} contains an empty sequence ID")


def not_finite(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def asymmetric(edges: DataFrame, value: str = "distance") -> DataFrame:
    """Pairs whose two values differ by more than 1e-10 + 1e-7 of the transposed one.

    Cells are summed up by hashes (64 bits) over squares of 512 members each way, those below the diagonal with the other sign; only where a sum is not zero,
    or a value is infinite, are cells moved to meet their transposed ones.
    """
    low, high = F.least("i", "j"), F.greatest("i", "j")
    square = {"_low": F.shiftright(low, 9), "_high": F.shiftright(high, 9)}
    side = (F.col("i") < F.col("j")).cast("long") - (F.col("i") > F.col("j")).cast("long")
    h = F.xxhash64(low, high, F.col(value))
    sums = edges.groupBy("family", *[c.alias(n) for n, c in square.items()]).agg(F.try_sum(side * F.shiftright(h, 32)).alias("a"), F.try_sum(side * h.bitwiseAND(F.lit((1 << 32) - 1))).alias("b"), F.count_if(F.abs(F.col(value)) == float("inf")).alias("c"))
    open_ = settled(sums.filter("a is null or b is null or a <> 0 or b <> 0 or c > 0").select("family", *square))
    n = open_.count()
    cells = edges.withColumns(square).join(F.broadcast(open_) if n <= BROADCAST_ROWS else open_, ["family", *square]) if n else edges.filter(F.lit(False))
    t = cells.select("family", F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("other"))
    gap = F.abs(F.col(value) - F.col("other"))
    return cells.join(t, ["family", "i", "j"]).filter(gap > 1e-10 + 1e-7 * F.abs(F.col("other"))).select("family", "i", "j", gap.alias("difference"))


def matrix_report(edges: DataFrame, value: str = "distance") -> DataFrame:
    """For each family: rows, columns, cells, and how many cells break a rule."""
    return edges.groupBy("family").agg(
        F.count_distinct("i").alias("n_rows"),
        F.count_distinct("j").alias("n_columns"),
        F.count("*").alias("n_cells"),
        F.count_if(not_finite(value)).alias("n_not_finite"),
        F.count_if(F.col(value) < 0).alias("n_negative"),
        F.count_if((F.col("i") == F.col("j")) & (F.col("src") != F.col("dst"))).alias("n_order_breaks"),
    )


def validate_square_matrix(edges: DataFrame, value: str = "distance", name: str = "matrix", symmetric: bool = True, nonnegative: bool = False) -> DataFrame:
    """edges, if every family is square, in one order, finite, and as asked symmetric and non-negative."""
    text = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    least = lambda rule, *c: F.min(F.when(rule, text(*c)))
    report = matrix_report(edges, value).agg(
        F.when(F.count("*") == 0, "none").alias("_0"),
        least(F.expr("n_rows <> n_columns or n_cells <> n_rows * n_columns"), "family", "n_rows", "n_columns").alias("_1"),
        least(F.col("n_order_breaks") > 0, "family").alias("_4"),
        least(F.col("n_not_finite") > 0, "family").alias("_5"),
        least((F.col("n_negative") > 0) & F.lit(nonnegative), "family").alias("_6"),
    )
    ids = edges.filter("i = 0").groupBy("family", F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    ids = ids.agg(least(F.col("n") > 1, "family", "id").alias("_2"), least(F.trim("id") == "", "family").alias("_3"))
    messages = ["contains no sequence IDs", "must be square", "contains duplicate sequence IDs", "contains an empty sequence ID", "row and column IDs differ", "contains NaN or infinite values", "contains negative values", "must be symmetric; largest difference"]
    sides = [report, ids]
    if symmetric:
        sides.append(asymmetric(edges, value).agg(F.max_by(text("family", "i", "j", "difference"), "difference").alias("_7")))
    # one action for all rules; the sides are a row each
    faults = None
    for side in sides:
        rows = side.select(F.explode(F.array(*[F.struct(F.lit(int(c[1:])).alias("rule"), F.col(c).alias("shown")) for c in side.columns])).alias("f")).select("f.*")
        faults = rows if faults is None else faults.union(rows)
    first = faults.filter("shown is not null").agg(F.min_by("shown", "rule"), F.min("rule")).first()
    if first[1] is not None:
        raise ValueError(f"{name} {messages[first[1]]}" + (f": {first[0]}" if first[1] else ""))
    return edges


def reconcile(reference: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with `side` missing (from other) or extra."""
    tagged = reference.select(*keys, F.lit(True).alias("_left")).union(other.select(*keys, F.lit(False).alias("_left")))
    sides = tagged.groupBy(*keys).agg(F.bool_or("_left").alias("_in"), F.bool_or(~F.col("_left")).alias("_out"))
    return sides.filter("_in <> _out").select(*keys, F.when(F.col("_in"), "missing").otherwise("extra").alias("side"))


def validate_sequence_ids(reference: DataFrame, *others: tuple[str, DataFrame], require_same_order: bool = True) -> None:
    """Tables of (family, ord, sequence_id) hold the same ids, and in the same order if asked."""
    keys = ["family", "sequence_id"]
    for name, other in others:
        fail_on(reconcile(reference, other, keys), f"{name} sequence IDs differ from the reference")
        if require_same_order:
            moved = reference.join(other.select(*keys, F.col("ord").alias("_ord")), keys).filter("ord <> _ord").select("sequence_id")
            fail_on(moved, f"{name} sequence ID order differs from the reference")


def validate_labels(labels: DataFrame) -> DataFrame:
    """Both columns there, no nulls, ids unique and not blank."""
    lost = [c for c in ("sequence_id", "known_subfamily") if c not in labels.columns]
    if lost:
        raise ValueError(f"label table lacks columns {lost}")
    fail_on(labels.filter("sequence_id is null or known_subfamily is null").select("sequence_id"), "label table contains missing values")
    validate_ids(labels, "sequence_id", "label table", [c for c in ("family",) if c in labels.columns])
    return labels


def missing_labels(ids: DataFrame, labels: DataFrame, keys: list[str], label: str = "known_subfamily") -> DataFrame:
    """The ids without a label: in no row of labels, or with a null one."""
    return ids.join(labels, keys, "left").filter(F.col(label).isNull()).select(*keys)


def lookup(facts: DataFrame, dimension: DataFrame, key: str, message: str) -> DataFrame:
    """facts with the columns of a small table; every key must stand there. Spark broadcasts it if it is small enough."""
    fail_on(facts.join(dimension, key, "left_anti").select(key), message)
    return facts.join(dimension, key)


def alignment_lengths(msa: DataFrame) -> DataFrame:
    return msa.groupBy("family").agg(F.count("*").alias("n_sequences"), F.min(F.length("seq")).alias("least_length"), F.max(F.length("seq")).alias("most_length"), (F.count_distinct(F.length("seq")) == 1).alias("equal_lengths"))


def validate_alignment(msa: DataFrame) -> DataFrame:
    if msa.isEmpty():
        raise ValueError("alignment contains no records")
    validate_ids(msa, "sequence_id", "alignment", ["family"])
    fail_on(alignment_lengths(msa).filter(~F.col("equal_lengths")).select("family"), "aligned sequences differ in length")
    return msa


def align_labels(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """labels in the order of expected (family, ord, sequence_id); ids must be the same set, each once."""
    keys = ["family", "sequence_id"]
    fail_on(duplicate_ids(labels, *keys).select("sequence_id"), "labels contain duplicate sequence IDs")
    fail_on(reconcile(expected, labels, keys), "labels and expected IDs differ")
    return expected.select(*keys, "ord").join(labels.drop("ord"), keys)


def validate_predictions(predictions: DataFrame, column: str = "predicted_cluster") -> None:
    fail_on(duplicate_ids(predictions, "family", "sequence_id").select("sequence_id"), "predictions contain duplicate sequence IDs")
    fail_on(predictions.filter(F.col(column).isNull()).select("sequence_id"), "predictions contain missing values")


def require_columns(df: DataFrame, *columns: str) -> None:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")


def family_set_differences(reference: DataFrame, others: dict[str, DataFrame], supersets: tuple[str, ...] = ("annotation",)) -> DataFrame:
    """(source, family, side) where a source's families are not the reference's; supersets may have more."""
    found = None
    for name, families in others.items():
        diff = reconcile(reference, families, ["family"])
        if name in supersets:
            diff = diff.filter("side = 'missing'")
        diff = diff.select(F.lit(name).alias("source"), "family", "side")
        found = diff if found is None else found.unionByName(diff)
    return found


def validate_family_sets(reference: DataFrame, others: dict[str, DataFrame], expected: int | None = None, exempt: tuple[str, ...] = ("family_metadata",)) -> None:
    some = {k: v for k, v in others.items() if k not in exempt}
    if some:
        fail_on(family_set_differences(reference, some).orderBy("source", F.col("family").cast("int")), "family sets differ", 10)
    if expected is not None and (n := reference.select("family").distinct().count()) != expected:
        raise ValueError(f"expected {expected} families, found {n}")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other."""
    return left.exceptAll(right).withColumn("side", F.lit("missing")).union(right.exceptAll(left).withColumn("side", F.lit("extra")))
