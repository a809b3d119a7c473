"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is DataFrame and SQL expressions.

1. Sizes in words of each source and of each of its blocks (rows dealt by a hash of id and text);
   there are `BLOCKS_PER_SHARD` blocks a source for each output shard, `BLOCKS` at least, so a draw
   stays small beside a shard as the corpus grows.
2. Targets: the corpus's total is shared by weight; no source gets over `most` times its own size,
   and what it leaves is shared by weight among the others.
3. Quotas, in draws of blocks: all blocks once for each whole epoch that the target holds, then as
   many blocks of one further permuted epoch as come nearest to the target; of `TRIES` permutations
   the one that comes nearest.
4. The tree: the root holds the quota of each source. Each node sends an exact number of draws to
   its left half, taken from the sources by sequential hypergeometric draws (inverse distribution
   function of a hashed uniform number), until each leaf is one output shard.
5. Each shard owns a range of each source's places, in which the blocks of all epochs stand permuted.
   A block is in the mix once for each of its places that some shard owns, so the shards' draws are
   disjoint, and together they are the mix. Rows are ordered inside their shard by a keyed hash.

Documents meet their source's draws by one join on (source, block), which broadcasts the draws only
if they fit the bound; else it shuffles by (source, block), which splits a hot source into its blocks.
Sources stand in one row, in code point order: a mix has a weight for each, so their number is that
of a configuration, not of the corpus.

Defined cases: null sources are one source, last in order; a null text has size 0; documents of
size 0 are in the mix as often as their block is and add no words; repeated rows count once each and
share a block; null doc_ids are dealt by their text; an empty table gives no rows; further columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, broadcast_if, quoted, stored, text_or_empty

BLOCKS = 1024
BLOCKS_PER_SHARD = 4
TRIES = 16  #: permutations of a source's last epoch, of which the nearest to the target counts
LEAST_SHARDS = 64
MOST = 3
SEED = "mix-1"


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def _hyper(pop: str, good: str, n: str, u: str) -> str:
    """SQL for the count of `good` among n draws from pop without replacement, at uniform u.

    Log probabilities follow from one to the next; the support is cut 12 standard deviations from
    the mean, beyond which double precision sees nothing.
    """
    mean = f"(cast({n} as double) * {good} / greatest({pop}, 1))"
    spread = f"(20 + 12 * sqrt({mean} * (1 - cast({good} as double) / greatest({pop}, 1))))"
    lo = f"greatest(0, {n} - ({pop} - {good}), cast(floor({mean} - {spread}) as bigint))"
    hi = f"least({good}, {n}, cast(ceil({mean} + {spread}) as bigint))"
    # t: log probability of x relative to the least x; m: their maximum; z: sum of exp(t - m)
    move = f"ln(cast({good} - x + 1 as double)) + ln(cast({n} - x + 1 as double)) - ln(cast(x as double)) - ln(cast({pop} - {good} - {n} + x as double))"
    total = f"""aggregate(sequence({lo}, {hi}), named_struct('t', 0D, 'm', 0D, 'z', 0D),
        (a, x) -> transform(array(a.t + if(x = {lo}, 0D, {move})), t -> named_struct('t', t, 'm', greatest(a.m, t), 'z', a.z * exp(a.m - greatest(a.m, t)) + exp(t - greatest(a.m, t))))[0],
        a -> a.m + ln(a.z))"""
    return f"""transform(array({total}), lz -> aggregate(sequence({lo}, {hi}), named_struct('t', 0D, 'c', 0D, 'x', cast({hi} as bigint), 'done', false),
        (a, x) -> if(a.done, a, transform(array(a.t + if(x = {lo}, 0D, {move})), t -> named_struct('t', t, 'c', a.c + exp(t - lz), 'x', if(a.c + exp(t - lz) >= {u}, cast(x as bigint), a.x), 'done', a.c + exp(t - lz) >= {u}))[0]),
        a -> a.x))[0]"""


def sized(docs: DataFrame, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """doc_id, size long, _source (never null), _block int, and all of docs' columns in `row`."""
    return docs.select(
        "doc_id",
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(blocks)).cast("int").alias("_block"),
        F.struct(*quoted(docs)).alias("row"),
    )


def targets(by_block: DataFrame, weights: dict[str | None, float] | None = None, most: int = MOST) -> DataFrame:
    """(_source, source_size, weight, target). Default weights are 1, 2, 3, repeating, by code point, null last."""
    by_source = by_block.groupBy("_source").agg(F.sum("words").alias("source_size"))
    # one row for each source meets in one task, as the weights and the levelling need their order
    order = Window.orderBy(F.col("_source") == "n", "_source")
    if weights is None:
        by_source = by_source.withColumn("weight", (1 + (F.row_number().over(order) - 1) % 3).cast("double"))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("n" if k is None else f"s{k}", float(v))])
        by_source = by_source.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("_source")), F.lit(0.0)))
    full = Window.orderBy("_ratio", "_source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = Window.orderBy("_ratio", "_source").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("_ratio", "_source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        by_source.withColumn("_cap", F.lit(most) * F.col("source_size"))
        .withColumn("_ratio", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("_level", F.try_divide((F.sum("source_size").over(full) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0))).cast("double"), F.sum("weight").over(behind)))
        .withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(full))
    )
    share = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))
    return levels.withColumn("target", F.coalesce(F.when(F.col("weight") > 0, share), F.lit(0.0))).select("_source", "source_size", "weight", "target")


def quotas(by_block: DataFrame, goals: DataFrame, tries: int = TRIES, seed: str = SEED) -> DataFrame:
    """(_source, epochs, turn, quota): draws of each source, of which those beyond whole epochs follow permutation `turn`."""
    blocks = by_block.join(goals, "_source").withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int"))
    blocks = blocks.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    order = Window.partitionBy("_source", "turn").orderBy(_digest(seed, "draw", F.col("turn"), F.col("_source"), F.col("_block")), "_block")
    ends = blocks.withColumn("n", F.row_number().over(order)).withColumn("off", F.abs(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rest")))
    nearest = ends.groupBy("_source", "epochs", "rest").agg(F.min(F.struct("off", "turn", "n")).alias("best"), F.max("n").alias("blocks"))
    some = F.when(F.col("best.off") < F.col("rest"), F.col("best.n")).otherwise(0)
    return nearest.select("_source", "epochs", "best.turn", (F.col("epochs").cast("long") * F.col("blocks") + some).alias("quota"))


def places(by_block: DataFrame, counts: DataFrame, seed: str = SEED) -> DataFrame:
    """(_source, _block, epoch, place): the blocks of whole epochs and of one more, permuted; place from 0."""
    each = by_block.select("_source", "_block").join(counts, "_source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    last = _digest(seed, "draw", F.col("turn"), F.col("_source"), F.col("_block"))
    key = F.when(F.col("epoch") == F.col("epochs"), last).otherwise(_digest(seed, "epoch", F.col("epoch"), F.col("_source"), F.col("_block")))
    place = F.row_number().over(Window.partitionBy("_source").orderBy("epoch", key, "_block")) - 1
    return each.withColumn("place", place.cast("long")).select("_source", "_block", "epoch", "place")


def owned(drawn: DataFrame, ranges: DataFrame) -> DataFrame:
    """(_source, _block, epoch, shard) of the places that lie in a shard's range; one sort, no range join."""
    none = F.lit(None)
    starts = ranges.filter("past > first").select("_source", F.col("first").alias("place"), F.lit(0).alias("kind"), none.cast("int").alias("_block"), none.cast("int").alias("epoch"), F.struct("shard", "past").alias("own"))
    stands = drawn.select("_source", "place", F.lit(1).alias("kind"), "_block", "epoch", none.cast(starts.schema["own"].dataType).alias("own"))
    held = F.last("own", ignorenulls=True).over(Window.partitionBy("_source").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return starts.union(stands).withColumn("own", held).filter("kind = 1 and place < own.past").select("_source", "_block", "epoch", "own.shard")


def splitting_tree(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """(shard, _source, first, past) from (_source, quota): each shard's range of each source's draws."""
    ordered = F.array_sort(F.collect_list(F.struct("_source", F.col("quota").cast("long").alias("quota"))))
    nodes = quotas.agg(ordered.alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    uniform = f"(cast(conv(substr(md5(cast(concat_ws('|', '{seed}', 'split', lo, hi, e._source) as binary)), 1, 12), 16, 10) as double) + 0.5) / {float(1 << 48)}D"
    draw = _hyper("s.pop", "e.quota", "s.n", f"({uniform})")
    for _ in range(max(0, (shards - 1).bit_length())):
        inner = nodes.withColumn("total", F.expr("aggregate(q, 0L, (t, e) -> t + e.quota)")).withColumn("half", F.expr("cast((hi - lo) div 2 as int)"))
        inner = inner.withColumn("left_n", F.expr("if(hi - lo > 1, cast(round(cast(total as double) * half / (hi - lo)) as bigint), total)"))
        got = F.expr(f"""aggregate(q, named_struct('pop', total, 'n', left_n, 'out', cast(array() as array<struct<_source:string,quota:bigint>>)),
            (s, e) -> transform(array({draw}), x -> named_struct('pop', s.pop - e.quota, 'n', s.n - x, 'out', concat(s.out, array(named_struct('_source', e._source, 'quota', x)))))[0],
            s -> s.out)""")
        inner = inner.withColumn("left_q", F.explode(F.array(F.when(F.col("hi") - F.col("lo") > 1, got).otherwise(F.col("q")))))
        right = F.expr("zip_with(q, left_q, (a, b) -> named_struct('_source', a._source, 'quota', a.quota - b.quota))")
        one = F.struct("lo", (F.col("lo") + F.greatest("half", F.lit(1))).alias("hi"), F.col("left_q").alias("q"))
        two = F.struct((F.col("lo") + F.col("half")).alias("lo"), "hi", right.alias("q"))
        nodes = inner.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, F.array(one, two)).otherwise(F.array(one))).alias("node")).select("node.*")
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("e")).select("shard", "e._source", "e.quota")
    before = Window.partitionBy("_source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("quota").over(before), F.lit(0))
    return leaves.withColumn("first", first).withColumn("past", F.col("first") + F.col("quota")).drop("quota")


def plan(docs: DataFrame, weights: dict[str | None, float] | None = None, shards: int | None = None, blocks: int | None = None, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, size, row, source_size, target, shards): row has docs' columns, shards the output shard of each copy in the mix.

    By default there are as many shards as shuffle partitions, so that they stay of one size as the corpus grows.
    """
    shards = shards or max(LEAST_SHARDS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks or max(BLOCKS, BLOCKS_PER_SHARD * shards)
    with_size = sized(docs, blocks, seed)
    by_block = stored(with_size.groupBy("_source", "_block").agg(F.sum("size").alias("words")))
    goals = targets(by_block, weights, most)
    counts = stored(quotas(by_block, goals, seed=seed))
    ranges = splitting_tree(counts.select("_source", "quota"), shards, seed)
    copies = owned(places(by_block, counts, seed), ranges).groupBy("_source", "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("shards"))
    per_block = stored(by_block.select("_source", "_block").join(goals.select("_source", "source_size", "target"), "_source").join(copies, ["_source", "_block"], "left"))
    out = with_size.join(broadcast_if(per_block, per_block.count(), 96), ["_source", "_block"])
    return out.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))


def mix(docs: DataFrame, seed: str = SEED, shards: int | None = None, **options) -> DataFrame:
    """The mixed corpus: docs' columns, a row for each copy, shuffled within each shard; a task holds one shard."""
    shards = shards or max(LEAST_SHARDS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    planned = plan(docs, seed=seed, shards=shards, **options)
    copies = planned.select("doc_id", "row", F.posexplode("shards").alias("copy", "shard"))
    keyed = copies.withColumn("key", F.xxhash64(F.lit(seed), "copy", "doc_id", "row.text"))
    return keyed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key").select("row.*")
