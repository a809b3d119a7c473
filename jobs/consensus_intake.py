"""Takes in sequences as they arrive and keeps each family's consensus up to date.

    python -m jobs.consensus_intake --config jobs/consensus_intake.json --documents D --output OUT

A file stream reads only what is new under D, a folder or a pattern of files (its checkpoint is OUT/checkpoint); the run ends when all that is there is taken in.
Each batch goes to two tables, partitioned by batch: OUT/sequences has a row for each new (family, id, sequence) with
its status (accepted; blank; no id; repeated id; copy of a sequence of the family), OUT/votes how many accepted members have each letter
in each column. Votes add up, so OUT/consensus, partitioned by family, follows for the families that got new members from
all batches' votes, without an old sequence being read again.

A batch that is repeated after a failure replaces its own partitions and sees earlier batches only, so it gives the same result.
Within a batch the least (family, sequence) of an id and the least id of equal sequences count; an earlier batch comes first.
White space is a gap. A column stays in the consensus if at least `least_share` of the members have a letter there; of letters as
common the one of the least id stands.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import main
from quillon.operators.sequences import GAP, column_counts
from quillon.session import settled

LOG = logging.getLogger("consensus_intake")
SEQUENCES = "family string, sequence_id long, digest string, n_letters long, n_rows long, status string, batch long"
VOTES = "family string, pos int, base string, n long, first long, batch long"
CONSENSUS = "n_sequences long, length long, consensus string, family string"
KEY = ["family", "sequence_id", "digest"]


def arrivals(rows: DataFrame) -> DataFrame:
    """A row for each (family, sequence_id, digest): seq, n_letters and how many rows it stands for."""
    seq = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\n\\t\\r]", GAP)
    told = rows.select(F.coalesce("source", F.lit("?")).alias("family"), F.col("doc_id").alias("sequence_id"), seq.alias("seq"))
    letters = F.length(F.regexp_replace("seq", GAP, "")).cast("long")
    return told.withColumn("digest", F.md5("seq")).groupBy(*KEY).agg(F.first("seq").alias("seq"), F.count("*").alias("n_rows")).withColumn("n_letters", letters)


def judged(new: DataFrame, earlier: DataFrame) -> DataFrame:
    """new with its status. Joins are by keys that few rows share; equal sequences meet in aggregates alone."""
    able = new.filter("sequence_id is not null and n_letters > 0").select(*KEY)
    taken = earlier.filter("status = 'accepted'")
    by_id = able.groupBy("sequence_id").agg(F.min(F.struct("family", "digest")).alias("m")).select("sequence_id", "m.family", "m.digest")
    fresh = by_id.join(taken.select("sequence_id"), "sequence_id", "left_anti")
    by_text = fresh.groupBy("family", "digest").agg(F.min("sequence_id").alias("sequence_id"))
    won = by_text.join(taken.select("family", "digest"), ["family", "digest"], "left_anti")
    marked = new.join(fresh.withColumn("_fresh", F.lit(True)), KEY, "left").join(won.withColumn("_won", F.lit(True)), KEY, "left")
    status = F.when(F.col("sequence_id").isNull(), "no id").when(F.col("n_letters") == 0, "blank").when(F.col("_fresh").isNull(), "repeated id").when(F.col("_won").isNull(), "copy").otherwise("accepted")
    return marked.withColumn("status", status).drop("_fresh", "_won")


def consensus_of(votes: DataFrame, sizes: DataFrame, least_share: float) -> DataFrame:
    """CONSENSUS from votes (family, pos, base, n, first) and sizes (family, n_sequences)."""
    cells = votes.groupBy("family", "pos", "base").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    columns = cells.groupBy("family", "pos").agg(F.max_by("base", F.struct("n", -F.col("first"))).alias("base"), F.sum("n").alias("letters"))
    kept = columns.join(sizes, "family").filter(F.col("letters") >= F.col("n_sequences") * least_share)
    whole = kept.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda e: e["base"]), "").alias("consensus"))
    return sizes.join(whole, "family", "left").select("n_sequences", F.length(F.coalesce("consensus", F.lit(""))).cast("long").alias("length"), F.coalesce("consensus", F.lit("")).alias("consensus"), "family")


def run(spark: SparkSession, documents: str, output: str, least_share: float = 0.5) -> DataFrame:
    """Takes in what is new under documents; gives back all of output's sequences and consensuses, as read from there."""
    read = lambda name, kind: spark.read.schema(kind).parquet(f"{output}/{name}")
    put = lambda df, name, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{output}/{name}")

    def take(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        number = F.lit(batch).cast("long").alias("batch")
        mine = lambda name, kind: own.read.schema(kind).parquet(f"{output}/{name}")
        new = settled(arrivals(rows))
        earlier = mine("sequences", SEQUENCES).filter(F.col("batch") < batch) if batch else own.createDataFrame([], SEQUENCES)
        told = settled(judged(new, earlier))
        put(told.select(*KEY, "n_letters", "n_rows", "status", number), "sequences", "batch")
        accepted = told.filter("status = 'accepted'").select("family", F.col("sequence_id").alias("ord"), "seq")
        put(column_counts(accepted, ["family"]).filter(F.col("base") != GAP).select("family", "pos", "base", "n", "first", number), "votes", "batch")
        touched = settled(accepted.select("family").distinct())
        upto = F.col("batch") <= batch
        sizes = mine("sequences", SEQUENCES).filter(upto & (F.col("status") == "accepted")).join(touched, "family", "left_semi").groupBy("family").agg(F.count("*").alias("n_sequences"))
        put(consensus_of(mine("votes", VOTES).filter(upto).join(touched, "family", "left_semi"), sizes, least_share), "consensus", "family")
        counts = {r["status"]: r["count"] for r in told.groupBy("status").count().collect()}
        LOG.info("batch %s: read %s new sequences from %s; wrote %s to %s, consensuses of %s families", batch, sum(counts.values()), documents, counts, output, touched.count())

    stream = spark.readStream.schema(spark.read.parquet(documents).schema).parquet(documents)
    writer = stream.select("doc_id", "source", "text").writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    LOG.info("%s holds all of %s that was there", output, documents)
    none = F.lit(None)
    sequences = read("sequences", SEQUENCES).select("family", "sequence_id", "status", "digest", F.col("n_letters").alias("length"), F.col("n_rows").alias("members"))
    found = read("consensus", CONSENSUS).select("family", none.cast("long").alias("sequence_id"), F.lit("consensus").alias("status"), F.md5("consensus").alias("digest"), "length", F.col("n_sequences").alias("members"))
    return sequences.unionByName(found)


if __name__ == "__main__":
    main("consensus_intake", __doc__, run, ("documents", "output"))
