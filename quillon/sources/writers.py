"""Writers. Tables are written by the executors as folders, or as one file of the given name where asked."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _one_file(df: DataFrame, path: str, write) -> None:
    """What write makes of df, a folder of one part, moved to the file of this name in whatever store it lies."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    write(df.coalesce(1).write, folder.toString())
    store = target.getFileSystem(conf)
    (part,) = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")]
    store.delete(target, True)
    if not store.rename(part, target):
        raise OSError(f"cannot write {path}")
    store.delete(folder, True)


def write_dataframe(df: DataFrame, path: str, format: str = "csv", single: bool = False, index: str | None = None) -> None:
    """A folder of files, made with its parents and written over; single: one CSV file, for small results.

    index: the column that comes first, as a table's row names.
    """
    out = df if index is None else df.select(f"`{index}`", *[f"`{c}`" for c in df.columns if c != index])
    if single:
        if format != "csv":
            raise ValueError("only CSV is written as one file")
        ordered = [F.col(f"`{c}`") for c in ("family", "ord") if c in out.columns]
        _one_file(out.orderBy(*ordered) if ordered else out, path, lambda w, p: w.option("header", True).csv(p))
        return
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if format == "csv" else writer.format(format).save(path)


def write_matrix(edges: DataFrame, path: str, value: str) -> None:
    """One family's edges as a square CSV with row and column names."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.col(value).cast("string").alias("v")))), lambda e: e["v"]), ",")
    rows = edges.groupBy("i", _quoted(F.col("src")).alias("src")).agg(cells.alias("cells")).select("i", F.concat_ws(",", "src", "cells").alias("value"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", _quoted(F.col("dst")).alias("v")))), lambda e: e["v"]), ",")
    head = edges.filter("i = 0").agg(F.lit(-1).alias("i"), F.concat(F.lit(","), names).alias("value"))
    _one_file(head.union(rows).orderBy("i").select("value"), path, lambda w, p: w.text(p))


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _write_rows(rows: DataFrame, path: str, head: Column, name: Column, separator: str) -> None:
    cells = F.array_join(F.transform("distances", lambda d: d.cast("string")), separator)
    line = F.concat(F.when(F.col("ids").isNotNull(), F.concat(head, F.lit("\n"))).otherwise(F.lit("")), F.concat_ws(separator, name, cells))
    # the order of rows holds: partitions are files by their names
    rows.select("family", line.alias("value")).write.partitionBy("family").options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).text(path)


def write_mldist_rows(rows: DataFrame, path: str) -> None:
    """Distance files of many families from `pairs.rows`: a folder for each, in compressed parts whose names have the order of the lines."""
    _write_rows(rows, path, F.col("n").cast("string"), F.col("src").cast("string"), " ")


def write_matrix_rows(rows: DataFrame, path: str) -> None:
    """Square CSVs with row and column names of many families from `pairs.rows`, in such parts."""
    names = F.array_join(F.transform("ids", lambda c: _quoted(c.cast("string"))), ",")
    _write_rows(rows, path, F.concat(F.lit(","), names), _quoted(F.col("src").cast("string")), ",")


def write_json(row: DataFrame | dict, path: str, spark: SparkSession | None = None) -> None:
    """One row as a JSON file: two spaces, characters as they are, a newline at the end. Written by Spark, so any path will do."""
    if isinstance(row, DataFrame):
        found = row.limit(1).collect()
        values, spark = found[0].asDict(recursive=True) if found else {}, row.sparkSession
    else:
        values, spark = row, spark or SparkSession.getActiveSession()
    text = json.dumps(values, indent=2, ensure_ascii=False)
    _one_file(spark.createDataFrame([(text,)], "value string"), path, lambda w, p: w.text(p))


def write_fasta(records: DataFrame, path: str) -> None:
    """Header and sequence lines in member order."""
    records.orderBy("ord").select(F.concat(F.lit(">"), "sequence_id", F.lit("\n"), "seq").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_mldist(edges: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """A distance file of one family, with ids replaced by `names` (sequence_id, public_id) and the distances' text as it was."""
    value = "distance_text" if "distance_text" in edges.columns else "distance"
    rows = edges.groupBy("i", "src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.col(value).cast("string").alias("v")))), lambda e: e["v"]), " ").alias("cells"))
    if names is not None:
        rows = rows.join(names, rows["src"] == names["sequence_id"]).withColumn("src", F.col("public_id"))
    head = rows.agg(F.lit(-1).alias("i"), F.count("*").cast("string").alias("value"))
    body = rows.select("i", F.concat_ws(" ", "src", "cells").alias("value"))
    head.union(body).orderBy("i").select("value").coalesce(1).write.mode("overwrite").text(path)


def public_names(ids: DataFrame, family: str | None = None) -> DataFrame:
    """(sequence_id, public_id): numbered names in table order; with no family given, (family, ...) of each that ids hold."""
    from quillon.functions.text import public_id
    from quillon.operators.numbering import numbered

    if family is None:
        return numbered(ids.select("family", "sequence_id", "ord"), ["family"], ["ord"], "_n").select("family", "sequence_id", public_id("family", F.col("_n") + 1).alias("public_id"))
    return numbered(ids.select("sequence_id", "ord"), [], ["ord"], "_n").select("sequence_id", public_id(F.lit(family), F.col("_n") + 1).alias("public_id"))


def renaming_faults(before: DataFrame, after: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that renaming added or lost, and public names that still show where they came from."""
    from quillon.operators.checks import differing_rows

    mapped = before
    for k in keys:
        mapped = mapped.join(names.select(F.col("sequence_id").alias(k), F.col("public_id").alias("_new")), k).withColumn(k, F.col("_new")).drop("_new")
    moved = differing_rows(mapped.select(*after.columns), after).select(F.col(keys[0]).alias("sequence_id"), "side")
    shown = names.filter(F.col("public_id").rlike("DF|CM|:")).select(F.col("public_id").alias("sequence_id"), F.lit("private").alias("side"))
    return moved.union(shown)
