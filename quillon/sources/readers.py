"""Readers. Files of many families are read in one job.

The family is the one given, else the `family` that the folder names (family=x/...), else the file's stem.
Matrices, distances and alignments are read by line or record, whatever a file's size; tables of labels and results by
Spark's CSV parser, of unlike heads in one scan.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import schema
from quillon.functions.text import canonical_id, truthy
from quillon.operators.checks import fail_on, validate_alignment, validate_labels, validate_square_matrix
from quillon.operators.numbering import BROADCAST_ROWS
from quillon.session import settled


def _stem(path: str = "_metadata.file_name") -> Column:
    return F.regexp_extract(F.col(path), r"([^/]*?)(\.[^./]*)?$", 1)


def _family(rows: DataFrame, given: str | None, path: str = "_metadata.file_name") -> Column:
    return F.lit(given) if given is not None else F.col("family").cast("string") if "family" in rows.columns else _stem(path)


def _records(spark: SparkSession, path: str | list[str], family: str | None, mark: str = "") -> DataFrame:
    """(family, n, value): the records of each file that hold more than white space, numbered from 0 by their place.

    Records are lines, or with a mark what follows each line start that has it; what stands before the first is none.
    Files are split like any text. The records of a split are counted, and one row for each split reaches a window.
    """
    raw = spark.read.text(path, lineSep=f"\n{mark}")
    found = raw.select(_family(raw, family).alias("family"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("value"))
    if mark:  # a file's first record has its mark still, if it is one
        first = found.filter("block = 0").groupBy("file").agg(F.min("at").alias("start"))
        own = F.when(F.col("value").startswith(mark), F.substring("value", 1 + len(mark), 2**31 - 1))
        found = found.join(first, "file", "left").withColumn("value", F.when((F.col("block") == 0) & (F.col("at") == F.col("start")), own).otherwise(F.col("value"))).drop("start")
    kept = settled(found.filter(F.col("value").rlike(r"\S")))
    return _by_place(kept).select("family", "n", "value")


def _by_place(kept: DataFrame, within: str = "file") -> DataFrame:
    """Stored rows (file, block, at, ...) with n, their number from 0 in their file, or in their family's files by name, in place of block and at."""
    # within a split, places rise by one for each row; only where left out ones lie between do all need ranking
    keys = list(dict.fromkeys([within, "file", "block"]))
    splits = kept.groupBy(*keys).agg(F.min("at").alias("first"), F.count("*").alias("count"), F.max("at").alias("last"))
    if splits.filter("last - first + 1 <> count").isEmpty():
        before = F.coalesce(F.sum("count").over(Window.partitionBy(within).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = splits.select(*keys, "first", before.alias("before"))
        return kept.join(starts, keys).withColumn("n", (F.col("at") - F.col("first") + F.col("before")).cast("int")).drop("block", "at", "first", "before")
    ranks = kept.select(*keys, "at").withColumn("n", F.row_number().over(Window.partitionBy(within).orderBy("file", "block", "at")) - 1)
    return kept.join(ranks, [*keys, "at"]).drop("block", "at")


def _broken(rows: DataFrame, rules: list[tuple[Column, Column, str]]) -> None:
    """Raises for the first of the rules (broken, what to show, message) that any row breaks; all are looked at in one pass."""
    found = rows.agg(*[F.min(F.when(broken, shown.cast("string"))).alias(f"r{n}") for n, (broken, shown, _) in enumerate(rules)]).first()
    for value, (_, _, message) in zip(found, rules, strict=True):
        if value is not None:
            raise ValueError(f"{message}: {value}")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _lines(spark: SparkSession, path: str | list[str], family: str | None) -> DataFrame:
    """(family, file, block, at, key, value): the lines of matrix files that hold more than white space; key is a hash of the line."""
    raw = spark.read.text(path, lineSep="\n")
    value = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    found = raw.select(_family(raw, family).alias("family"), *place, value.alias("value"))
    return found.filter(F.col("value").rlike(r"\S")).withColumn("key", F.xxhash64("value"))


class _Matrices:
    """The lines of matrix files, looked at without being kept.

    A first pass keeps `facts` of each line and its number n in its family, whose files follow each other by name. Later passes read the text anew and know
    a line again by its hash, whatever splits they get; lines are kept if two of a family have one hash. At least one row for each line is kept, none for a cell.
    """

    def __init__(self, lines: DataFrame, facts: DataFrame):
        self.lines = lines
        self.places = settled(_by_place(settled(facts), "family"))
        self.count = self.places.count()
        twice = self.places.groupBy("family", "key").count().filter("count > 1")
        self.kept = None if twice.isEmpty() else _by_place(settled(lines), "family")

    def numbered(self) -> DataFrame:
        """lines with n."""
        if self.kept is not None:
            return self.kept
        n = F.coalesce("n", F.raise_error(F.lit("matrix files changed while they were read")).cast("int"))
        return self.lines.join(_small(self.places.select("family", "key", "n"), self.count), ["family", "key"], "left").withColumn("n", n)

    def edges(self, body: DataFrame, ids: DataFrame, texts: Column) -> DataFrame:
        """(family, i, j, src, dst, distance, distance_text) of body's lines, whose cells are texts; ids: (family, ids)."""
        cells = body.join(_small(ids, self.count), "family").select("family", (F.col("n") - 1).alias("i"), "src", "ids", F.posexplode(texts).alias("j", "distance_text"))
        return cells.select("family", "i", "j", "src", F.get("ids", "j").alias("dst"), F.col("distance_text").try_cast("double").alias("distance"), "distance_text")


def _in_order(rows: DataFrame, name: str) -> DataFrame:
    """(family, ids): each family's names by n."""
    return rows.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", name))), lambda e: e[name]).alias("ids"))


def _unread(texts: Column, allowed: Column | None = None) -> Column:
    """The least of texts that is no number, if any."""
    wrong = lambda x: x.try_cast("double").isNull() if allowed is None else x.try_cast("double").isNull() & (F.lower(F.trim(x)) != allowed)
    return F.when(F.exists(texts.try_cast("array<double>"), F.isnull), F.array_min(F.filter(texts, wrong)))


def scan_mldist(spark: SparkSession, path: str | list[str], family: str | None = None) -> DataFrame:
    """Edges of phylogenetic distance files: a count, then a row of id and distances for each sequence.

    Files are checked now, by line; edges are made from the text whenever they are used, and not kept.
    """
    lines = _lines(spark, path, family)
    words = lambda df: df.withColumn("cells", F.split(F.trim("value"), r"\s+"))
    texts = F.slice("cells", F.lit(2), F.size("cells") - 1)
    facts = words(lines).select("family", "file", "block", "at", "key", F.col("cells")[0].alias("src"), (F.size("cells") - 1).alias("width"), F.trim("value").try_cast("int").alias("size"), _unread(texts).alias("wrong"))
    found = _Matrices(lines, facts)
    heads, body = found.places.filter("n = 0"), found.places.filter("n > 0")
    shapes = body.groupBy("family").agg(F.count("*").alias("rows"), F.min("width").alias("least"), F.max("width").alias("most"))
    if heads.isEmpty():
        raise ValueError("mldist header is not a whole number: no file holds a line")
    name, size = F.col("family"), F.col("size")
    _broken(heads.select("family", "size").join(shapes, "family", "left"), [
        (size.isNull(), name, "mldist header is not a whole number"),
        (F.coalesce("rows", F.lit(0)) != size, name, "mldist row count differs from its header"),
        ((F.col("least") != size) | (F.col("most") != size), name, "mldist row has another number of distances"),
    ])
    _broken(body, [(F.col("wrong").isNotNull(), F.concat_ws(" ", "family", "src", "wrong"), "mldist distance is not a number")])
    rows = words(found.numbered().filter("n > 0")).withColumn("src", F.col("cells")[0])
    return found.edges(rows, _in_order(body, "src"), texts)


def read_mldist(spark: SparkSession, path: str | list[str], family: str | None = None) -> DataFrame:
    """Checked distance edges: square, symmetric, finite and not negative."""
    return validate_square_matrix(scan_mldist(spark, path, family).drop("distance_text"), name="distance matrix", nonnegative=True)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _quoted_cells(line: pd.Series) -> pd.Series:
    return pd.Series([next(csv.reader([x]), []) for x in line])


def _cells(lines: DataFrame) -> DataFrame:
    """lines with `cells` in place of value: plain splitting, or a parser for lines that hold a quote."""
    quoted = F.col("value").contains('"')
    plain = lines.filter(~quoted).select("family", "n", F.split("value", ",", -1).alias("cells"))
    return plain.union(lines.filter(quoted).select("family", "n", _quoted_cells("value").alias("cells")))


SQUARE = 9  #: bits of the side of a square whose hashes are summed up


def _hashes(low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64 bits of each cell (splitmix64's last steps)."""
    h = (values + 0.0).view(np.uint64) ^ ((low.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _line_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (family, i, n, fits, rest) by family and square: signed sums of hashes, in halves; with bi = -1, how many lines, and whether all are whole rows of finite numbers."""
    for batch in batches:
        sums: dict[tuple, int] = {}
        facts: dict[str, list] = {}
        for family, i, n, fits, rest in zip(*(batch.column(c) for c in ("family", "i", "n", "fits", "rest")), strict=True):
            family, i, n = family.as_py(), i.as_py(), n.as_py()
            fact = facts.setdefault(family, [0, True])
            fact[0] += 1
            if not fact[1]:
                continue
            try:
                values = pc.split_pattern(pa.array([rest.as_py()], pa.large_string()), ",").values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            except pa.ArrowInvalid:  # numbers in other forms are left to the checks by cell
                values = np.empty(0)
            if not fits.as_py() or len(values) != n or not 0 <= i < n or not np.isfinite(values).all():
                fact[1] = False
                continue
            j = np.arange(n)
            h = _hashes(np.minimum(i, j), np.maximum(i, j), values)
            h[:i] = -h[:i]
            h[i] = 0
            for b, s in enumerate(np.add.reduceat(h, np.arange(0, n, 1 << SQUARE)).tolist()):
                key = family, min(b, i >> SQUARE), max(b, i >> SQUARE)
                sums[key] = (sums.get(key, 0) + s) & (1 << 64) - 1
        rows = [(f, lo, hi, s >> 32, s & (1 << 32) - 1, None, None) for (f, lo, hi), s in sums.items()] + [(f, -1, -1, 0, 0, *fact) for f, fact in facts.items()]
        kinds = [batch.schema.field("family").type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["family", "bi", "bj", "high", "low", "lines", "whole"])


def _sound(lines: DataFrame, heads: DataFrame) -> bool:
    """Whether each family's lines (family, n, src, rest), without quotes past the first cell, make a square, finite and symmetric matrix under its head's ids.

    No cell becomes a row: lines are parsed in tasks that pass on sums of hashes, as `checks.asymmetric` takes them. False only says that a look at the cells must decide.
    """
    sizes = heads.select("family", "ids", F.size("ids").alias("size"))
    odd = sizes.filter((F.col("size") < 1) | (F.size(F.array_distinct("ids")) < F.col("size")) | F.exists("ids", lambda x: x.isNull() | (F.trim(x) == "")))
    if heads.isEmpty() or not odd.isEmpty():
        return False
    # ids meet lines by their places, so that no line carries them all
    placed = sizes.select("family", "size", F.posexplode("ids").alias("i", "id"))
    joined = lines.withColumn("i", F.col("n") - 1).join(_small(placed, heads.agg(F.sum(F.size("ids"))).first()[0]), ["family", "i"], "left")
    fits = F.coalesce(F.col("src") == F.col("id"), F.lit(False))
    each = joined.select("family", "i", F.coalesce("size", F.lit(-1)).alias("n"), fits.alias("fits"), F.coalesce("rest", F.lit("")).alias("rest"))
    found = each.mapInArrow(_line_sums, "family string, bi int, bj int, high long, low long, lines long, whole boolean")
    found = settled(found.groupBy("family", "bi", "bj").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("lines").alias("lines"), F.min("whole").alias("whole")))
    carried = (F.col("high") + F.shiftright("low", 32)) % F.lit(1 << 32)
    if not found.filter((F.col("low") % F.lit(1 << 32) != 0) | (carried != 0)).isEmpty():
        return False
    counts = found.filter("bi = -1").select("family", "lines", "whole")
    return sizes.join(counts, "family", "full").filter("lines is null or size is null or lines <> size or not whole").isEmpty()


#: A line whose first cell alone is in quotes.
_LED = r'^"([^"]*(?:""[^"]*)*)"(?:,([^"]*))?$'


def read_matrix_csv(spark: SparkSession, path: str | list[str], family: str | None = None) -> DataFrame:
    """Edges of a labelled square CSV, which must be symmetric but may be negative.

    Files are checked now, and edges made from the text whenever they are used. Of lines with quotes beyond the first cell the cells are kept. Lines are looked
    at whole; where these leave a doubt, their cells are looked at one by one, which also names the fault.
    """
    lines = _lines(spark, path, family)
    quoted = F.col("value").contains('"')
    lines = lines.withColumn("hard", quoted & ~F.col("value").rlike(_LED))
    own = F.array(F.replace(F.regexp_extract("value", _LED, 1), F.lit('""'), F.lit('"')))
    rest = F.when(F.col("value").endswith('"'), F.array().cast("array<string>")).otherwise(F.split(F.regexp_extract("value", _LED, 2), ",", -1))
    plain = lambda df: df.withColumn("cells", F.when(quoted, F.concat(own, rest)).otherwise(F.split("value", ",", -1)))
    texts, src = F.expr("slice(cells, 2, greatest(size(cells) - 1, 0))"), F.trim(F.col("cells")[0])
    wrong = _unread(texts, F.lit("nan"))
    parsed = plain(lines.withColumn("text", F.when(F.col("hard"), F.col("value"))).withColumn("value", F.when(~F.col("hard"), F.col("value"))))
    found = _Matrices(lines, parsed.select("family", "file", "block", "at", "key", "text", src.alias("src"), wrong.alias("wrong")))
    hard = settled(found.places.filter("text is not null").select("family", "n", _quoted_cells("text").alias("cells")))
    faults = found.places.select("family", "n", "src", "wrong").union(hard.select("family", "n", src, wrong))
    _broken(faults.filter("n > 0"), [(F.col("wrong").isNotNull(), F.concat_ws(" ", "family", "src", "wrong"), "matrix value is not a number")])
    rows = plain(found.numbered().filter("not hard")).select("family", "n", "cells")
    quoted_heads, easy = hard.filter("n = 0"), hard.filter("n > 0").isEmpty()
    if quoted_heads.count() < found.places.filter("n = 0").count():  # else no line needs to be read for them
        quoted_heads = quoted_heads.union(rows.filter("n = 0"))
    heads = settled(quoted_heads.select("family", F.transform(texts, lambda x: F.trim(x)).alias("ids")))
    body = plain(found.numbered().filter("n > 0")) if easy else rows.union(hard).filter("n > 0")
    edges = found.edges(body.withColumn("src", src), heads, texts).drop("distance_text")
    if easy:
        after = F.when(quoted, F.regexp_extract("value", _LED, 2)).when(F.instr("value", ",") > 0, F.expr("substring(value, instr(value, ',') + 1)"))
        first = F.when(quoted, own[0]).otherwise(F.substring_index("value", ",", 1))
        if _sound(found.numbered().filter("n > 0").select("family", "n", F.trim(first).alias("src"), after.alias("rest")), heads):
            return edges
    return validate_square_matrix(edges, name="matrix")


def read_matrix_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(family, ord, sequence_id) from the first lines of matrix CSVs alone; ids unique and not empty."""
    raw = spark.read.text(path)
    lines = raw.select(_family(raw, None).alias("family"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # one line of each file leaves its task
    first = lines.filter("block = 0").groupBy("family").agg(F.min_by("value", "at").alias("value"))
    heads = settled(_cells(first.select("family", F.lit(0).alias("n"), F.regexp_replace("value", r"\r$", "").alias("value"))))
    ids = heads.select("family", F.posexplode(F.expr("slice(cells, 2, greatest(size(cells) - 1, 0))")).alias("ord", "sequence_id"))
    fail_on(heads.filter("size(cells) < 2").select("family"), "matrix header holds no sequence IDs")
    fail_on(ids.groupBy("family", "sequence_id").count().filter("count > 1 or trim(sequence_id) = ''").select("family", "sequence_id"), "matrix header IDs are empty or repeated")
    return ids


def _null_tokens(c: Column) -> Column:
    return F.when(~c.isin(schema.NULL_TOKENS), c)


def _tables(spark: SparkSession, path: str | list[str], family: str | None, columns: list[str], message: str, sep: str = ",") -> DataFrame:
    """(family, ord, _first, columns): rows of CSV files, each with a head of its own, in file order; _first is the first cell.

    A head is one line. A first pass finds the heads, and whether a quote spans lines; then Spark's parser reads, of the columns
    that any file needs, all files at once: in splits, or whole files as streams if a quote spans lines. Blank lines are no rows.
    """
    lines, files = spark.read.text(path), spark.read.format("binaryFile").load(path)  # of the latter the names alone
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    text = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("value"), (quotes % 2 == 1).alias("open"))
    seen = text.filter(F.col("value").rlike(r"\S")).groupBy("file").agg(F.min_by("value", "at").alias("value"), F.max("open").alias("open"))
    heads = settled(files.select(_family(files, family).alias("family"), F.col("_metadata.file_path").alias("file")).join(seen, "file", "left"))
    width, spans, count = heads.agg(F.max(F.size(F.split("value", f"[{sep}]", -1))), F.max("open"), F.count("*")).first()
    if count < len(files.inputFiles()):  # scans pass over files without a byte
        raise ValueError(f"{message} {columns[0]}: a file is empty")
    names = [f"_c{n}" for n in range(max(width or 0, 1))]
    options = {"sep": sep, "escape": '"', "maxColumns": str(len(names) + 20480)}
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names), options)
    found = heads.withColumn("_head", parsed).withColumn("_head", F.array(*[F.col(f"_head.{n}") for n in names]))
    found = settled(found.select("family", "file", *[(F.coalesce(F.array_position("_head", c), F.lit(0)) - 1).cast("int").alias(f"p{m}") for m, c in enumerate(columns)]))
    _broken(found, [(F.col(f"p{m}") < 0, F.col("family"), f"{message} {c}") for m, c in enumerate(columns)])
    used = sorted({0} | {r[0] for r in found.select(F.explode(F.array(*[f"p{m}" for m in range(len(columns))]))).distinct().collect()})
    raw = spark.read.csv(path, schema=", ".join(f"_c{n} string" for n in range(used[-1] + 1)), header=False, multiLine=bool(spans), **options)
    blank = F.coalesce(F.trim("_c0") == "", F.lit(False))
    for n in used[1:]:
        blank = blank & F.col(f"_c{n}").isNull()
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), *[f"_c{n}" for n in used])
    placed = _by_place(settled(rows.filter(~blank))).filter("n > 0").join(found, "file")
    value = lambda m: F.coalesce(*[F.when(F.col(f"p{m}") == n, F.col(f"_c{n}")) for n in used])
    return placed.select("family", (F.col("n") - 1).alias("ord"), F.coalesce("_c0", F.lit("")).alias("_first"), *[_null_tokens(value(m)).alias(c) for m, c in enumerate(columns)])


def read_labels(spark: SparkSession, path: str | list[str], family: str | None = None) -> DataFrame:
    """(family, ord, sequence_id, known_subfamily), all text; what pandas reads as missing is missing here."""
    rows = _tables(spark, path, family, ["sequence_id", "known_subfamily"], "label table lacks sequence_id or known_subfamily:")
    return validate_labels(rows.drop("_first"))


def scan_fasta(spark: SparkSession, path: str | list[str], family: str | None = None) -> DataFrame:
    """(family, ord, sequence_id, seq): the first word of each header, the lines under it joined."""
    records = _records(spark, path, family, ">").withColumn("value", F.regexp_replace("value", r"\r\n?", "\n"))
    head, body = F.element_at(F.split("value", "\n", 2), 1), F.try_element_at(F.split("value", "\n", 2), F.lit(2))
    return records.select("family", F.col("n").alias("ord"), F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("sequence_id"), F.regexp_replace(F.coalesce(body, F.lit("")), r"\s", "").alias("seq"))


def read_alignment(spark: SparkSession, path: str | list[str], family: str | None = None) -> DataFrame:
    """A checked alignment: some records, unique ids, equal lengths."""
    return validate_alignment(scan_fasta(spark, path, family))


def numeric_csv_families(spark: SparkSession, directory: str) -> DataFrame:
    """(family): the stems of a directory's CSV files that are all digits. No file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory).select(_stem("path").alias("family"))
    return files.filter(F.col("family").rlike("^[0-9]+$")).distinct()


def annotation_used(annotation: DataFrame) -> DataFrame:
    """(sequence_id, known_subfamily) of the rows in use, colons in names as underscores."""
    return annotation.filter(truthy("used")).select(canonical_id("name").alias("sequence_id"), F.col("subfamily").alias("known_subfamily"))


def read_annotation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(family, sequence_id, known_subfamily) of the rows in use; ids unique within a family."""
    rows = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    used = rows.filter(truthy("used")).select(_family(rows, None).alias("family"), canonical_id("name").alias("sequence_id"), F.col("subfamily").alias("known_subfamily"))
    fail_on(used.groupBy("family", "sequence_id").count().filter("count > 1").select("family", "sequence_id"), "annotation repeats IDs in use")
    return used


def read_result_table(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """(family, sequence_id, columns as text): per-family result CSVs whose first column is the id."""
    rows = _tables(spark, path, None, columns, "result table lacks")
    return rows.drop("ord").withColumnRenamed("_first", "sequence_id")


def read_candidate_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(family, k, mean_silhouette, adjusted_rand_index) from tables of `ARI score` and `silhouettes` by k."""
    t = read_result_table(spark, path, ["ARI score", "silhouettes"])
    return t.select("family", F.col("sequence_id").cast("double").cast("int").alias("k"), F.col("silhouettes").cast("double").alias("mean_silhouette"), F.col("ARI score").cast("double").alias("adjusted_rand_index"))


def read_family_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(family, order, TE)"""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("family_ID").cast("double").cast("int").cast("string").alias("family"), "order", "TE")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular local-alignment hits, comments skipped; none where there is no file, as a search without hits may leave none."""
    try:
        return spark.read.csv(path, sep="\t", comment="#", schema=schema.HITS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema.HITS)
