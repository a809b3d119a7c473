"""Prefix trie of conversations: mergeable partial tries, a tree of merges, and a rollup from the leaves.

Turns become digests at once, so no text is shuffled. Turns sorted by conversation lie in range partitions, so a conversation of any
length is divided among tasks; each task gets from the driver what its first conversation carries over from the tasks
before it (one row a partition). A prefix is known by the bitwise sum (xor) of its turns' digests, each mixed with its place.

Partial tries: each partition combines its own prefixes into a node table (members, least member, ids of those that end there).
Merges: node tables of `FAN` neighbouring partitions are summed by node, again and again, until there is one. Lists of
ends stay in pieces of at most `ENDS` ids in ascending order; they are hashed as a stream.

Rollup: the nodes with one least member form a path downwards, as the least member of a node is that of one child too.
So subtree sums are sums along paths plus those of the paths that branch off: over the tree of paths by pointer doubling (each
round sums what lies twice as far below), then one scan along all paths. The nesting of paths grows with the logarithm of
the number of conversations if ids fall on them by chance; rounds are the logarithm of the nesting.

Defined cases: a null role or text is empty; a null turn comes first; turns alike in number go by their digests, so reruns agree; repeated
rows are turns of their own; rows without a conv_id belong to none and are left out; c - c % 100 and % are Spark's (of the sign of c); an
empty table gives no rows (no conversation, no root); other columns, whatever their names, are ignored; texts of any length are
digested where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored, text_or_empty
from quillon.llm.graph import join_hot

HEADS, BLOCK = 6, 100  #: a conversation takes fewer than HEADS turns from the first of its BLOCK
FAN = 32  #: node tables that one merge makes one of
ENDS = 1 << 15  #: ids of one piece of a list of ends
EMPTY = hashlib.sha256(b"").hexdigest()

Arrays = dict[str, np.ndarray | pa.Array]


# ---- scans over sorted partitions


def _segments(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))


def _arrays(batch: pa.RecordBatch) -> Arrays:
    """By name; strings and columns with nulls stay Arrow arrays."""
    return {n: c if c.null_count or pa.types.is_string(c.type) else c.to_numpy() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def running(values: np.ndarray, key: np.ndarray, xor: bool) -> np.ndarray:
    """Running sums (or xors) of values within runs of equal keys, each value included."""
    if not len(key):
        return values
    start = _segments(key)
    total = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    before = np.concatenate((np.zeros(1, total.dtype), total))[start]
    each = np.repeat(before, np.diff(start, append=len(key)))
    return total ^ each if xor else total - each


class Scan:
    """Running values along each key of rows that are sorted by it over stored partitions.

    values: column -> whether it is xored rather than summed. Partition numbers come from the stored column `_mid`.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[Column], values: dict[str, bool]):
        self.key, self.values = key, values
        tie = F.monotonically_increasing_id()
        ranged = rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
        self.rows = stored(ranged.withColumn("_mid", F.monotonically_increasing_id()))
        self.parts = self.rows.rdd.getNumPartitions()
        self.carry, self.following = self._carried()

    def _carried(self) -> tuple[dict[int, tuple], dict[int, int]]:
        """By partition: the key it goes on with and that key's values so far; and the first key after it."""
        key, values = self.key, self.values

        def ends(batches):
            first = last = part = None
            sums = dict.fromkeys(values, 0)
            for batch in batches:
                a = _arrays(batch)
                k = a[key]
                if not len(k):
                    continue
                if first is None:
                    first, part = int(k[0]), int(a["_mid"][0]) >> 33
                at = int(_segments(k)[-1])
                if at or int(k[0]) != last:
                    sums = dict.fromkeys(values, 0)
                last = int(k[-1])
                for v, xor in values.items():
                    x = a[v][at:]
                    sums[v] = sums[v] ^ int(np.bitwise_xor.reduce(x)) if xor else sums[v] + int(x.sum())
            if first is not None:
                yield pa.RecordBatch.from_pydict({c: pa.array([x], pa.int64()) for c, x in {"part": part, "first": first, "last": last, **sums}.items()})

        kind = "part long, first long, last long" + "".join(f", {v} long" for v in values)
        found = sorted(self.rows.select("_mid", key, *values).mapInArrow(ends, kind).collect())
        carry, following, held = {}, {}, (None, {})
        for r in found:
            if held[0] == r["first"]:
                carry[r["part"]] = held
            now = {v: r[v] for v in values}
            if held[0] == r["first"] == r["last"]:
                now = {v: held[1][v] ^ x if values[v] else held[1][v] + x for v, x in now.items()}
            held = r["last"], now
        for r, after in zip(found, found[1:], strict=False):
            following[r["part"]] = after["first"]
        return carry, following

    def map(self, step: Callable[[Arrays, int], Iterator[Arrays] | None], columns: list[str], schema: str, close: Callable | None = None) -> DataFrame:
        """Rows of step's arrays (names as in schema): it gets the columns, running values as run_<name>, the row after as `ends` (last of its key), and the partition."""
        key, values, carry, following = self.key, self.values, self.carry, self.following
        names = [c.split(" ")[0] for c in schema.split(", ")]

        def scan(batches):
            held: tuple = (None, {})
            part, waiting = None, None

            def ready(batch: pa.RecordBatch, next_key: int | None) -> Iterator[pa.RecordBatch]:
                nonlocal held
                a = _arrays(batch)
                k = a[key]
                first = int(_segments(k)[1]) if len(_segments(k)) > 1 else len(k)
                for v, xor in values.items():
                    run = running(a[v], k, xor)
                    if held[0] == int(k[0]):
                        head = run[:first]
                        run[:first] = head ^ np.int64(held[1][v]) if xor else head + held[1][v]
                    a[f"run_{v}"] = run
                held = int(k[-1]), {v: int(a[f"run_{v}"][-1]) for v in values}
                a["ends"] = np.append(k[1:] != k[:-1], next_key is None or next_key != int(k[-1]))
                out = step(a, part)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

            for batch in batches:
                if not batch.num_rows:
                    continue
                if part is None:
                    part = batch.column("_mid")[0].as_py() >> 33
                    held = carry.get(part, held)
                if waiting is not None:
                    yield from ready(waiting, batch.column(key)[0].as_py())
                waiting = batch
            if waiting is not None:
                yield from ready(waiting, following.get(part))

        return self.rows.select("_mid", key, *[c for c in dict.fromkeys((*columns, *values)) if c != key]).mapInArrow(scan, schema)


# ---- rebuilding


def _digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, d1, d2, chars): a 128-bit digest of role and text, and the text's code points."""
    role, text = text_or_empty("role"), text_or_empty("text")
    whole = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    lane = lambda at: F.conv(F.substring(whole, at, 16), 16, -10).cast("long")
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), lane(1).alias("d1"), lane(17).alias("d2"), F.length(text).cast("long").alias("chars"))


def _host(conv: str = "conv_id") -> Column:
    return F.col(conv) - F.col(conv) % BLOCK


def _taken(conv: str = "conv_id") -> Column:
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns (conv_id, place, d1, d2, chars) of the rebuilt conversations, unsorted; conv_ids of all conversations)."""
    placed = Scan(_digested(conversations).withColumn("one", F.lit(1).cast("long")), "conv_id", [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("d1"), F.col("d2")], {"one": False})
    turns = stored(placed.map(lambda a, _: {**a, "place": a["run_one"] - 1}, ["d1", "d2", "chars"], "conv_id long, place long, d1 long, d2 long, chars long"))
    convs = stored(turns.filter("place = 0").select("conv_id"))
    heads = turns.filter((F.col("place") < HEADS - 1) & (F.col("conv_id") % BLOCK == 0)).groupBy(F.col("conv_id").alias("host")).agg(F.collect_list(F.struct("place", "d1", "d2", "chars")).alias("head"))
    borrowed = convs.select("conv_id", _host().alias("host"), _taken().alias("h")).filter("h > 0").join(heads, "host").select("conv_id", "h", F.inline("head")).filter("place < h").drop("h")
    own = turns.filter(F.col("place") >= _taken())
    return borrowed.unionByName(own), convs


# ---- partial tries and their merges

NODE = "h1 long, h2 long, depth long, p1 long, p2 long, chars long, part long, members long, least long, ends array<bigint>"


def _mixed(lane: str) -> Column:
    """A turn's digest mixed with its place, one half of it."""
    return F.xxhash64(F.lit(lane), "depth", "d1", "d2")


def _combined(a: Arrays, part: int) -> dict:
    """A batch's own node table."""
    h1, h2, depth = a["run_x1"], a["run_x2"], a["depth"]
    order = np.lexsort((a["conv_id"], h2, h1, depth))
    key = np.stack((depth, h1, h2))[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
    start = np.flatnonzero(new)
    one, conv = order[start], a["conv_id"][order]
    ending = a["ends"][order]
    counts = np.add.reduceat(ending.astype(np.int64), start)
    return {
        "h1": h1[one], "h2": h2[one], "depth": depth[one], "p1": h1[one] ^ a["x1"][one], "p2": h2[one] ^ a["x2"][one], "chars": a["chars"][one],
        "part": np.full(len(one), part), "members": np.diff(start, append=len(order)), "least": conv[start],
        "ends": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(conv[ending])),
    }


def partial_tries(turns: DataFrame) -> tuple[DataFrame, int]:
    """(NODE rows of each partition's own trie, number of partitions). The root is not among them."""
    one = turns.withColumn("one", F.lit(1).cast("long"))
    depths = Scan(one, "conv_id", [F.col("conv_id"), F.col("place")], {"one": False})
    deep = depths.map(lambda a, _: {**a, "depth": a["run_one"]}, ["d1", "d2", "chars"], "conv_id long, depth long, d1 long, d2 long, chars long")
    paths = Scan(deep.withColumn("x1", _mixed("a")).withColumn("x2", _mixed("b")), "conv_id", [F.col("conv_id"), F.col("depth")], {"x1": True, "x2": True})
    return stored(paths.map(_combined, ["depth", "chars"], NODE)), paths.parts


def merged(tries: DataFrame, parts: int) -> DataFrame:
    """One node table (h1, h2, depth, p1, p2, chars, members, least) from those of all partitions, FAN to one in each round."""
    sums = [F.sum("members").alias("members"), F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("p1", "p2", "chars")]]
    nodes = tries.select("h1", "h2", "depth", "part", "p1", "p2", "chars", "members", "least")
    while parts > 1:
        nodes, parts = nodes.withColumn("part", F.floor(F.col("part") / FAN).cast("long")), -(-parts // FAN)
        nodes = nodes.groupBy("h1", "h2", "depth", "part").agg(*sums)
    return nodes.groupBy("h1", "h2", "depth").agg(*sums)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(h1, h2, ends_sha256) from pieces (h1, h2, ids), ids of one node in ascending order; no list is ever whole."""
    pieces = ends.withColumn("lo", F.col("ids")[0]).repartition("h1", "h2").sortWithinPartitions("h1", "h2", "lo")

    def digest(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for h1, h2, ids in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("ids"), strict=True):
                if (h1, h2) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (h1, h2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids.values.to_pylist())).encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["h1", "h2", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["h1", "h2", "ends_sha256"])

    return pieces.select("h1", "h2", "ids").mapInArrow(digest, "h1 long, h2 long, ends_sha256 string")


def _pieces(tries: DataFrame, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Pieces of lists of ends: those of partitions, in pieces of ENDS, and of the root (conversations without turns)."""
    some = tries.filter(F.size("ends") > 0).select("h1", "h2", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ends") - 1) / ENDS).cast("int")), lambda n: F.slice("ends", n * ENDS + 1, ENDS))).alias("ids"))
    turnless = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    zero = F.lit(0).cast("long")
    ranged = turnless.groupBy(F.floor(F.col("conv_id") / ENDS).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return some.unionByName(ranged.select(zero.alias("h1"), zero.alias("h2"), "ids"))


# ---- rollup


def _path_totals(paths: DataFrame) -> DataFrame:
    """(path, leaves, saved): sums over a path and all that branch off it, from (path, above, leaves, saved); above is null at the top.

    In round k each path holds the sums of what lies fewer than 2^k paths below it, and the path 2^k above it.
    """
    now = stored(paths)
    while (linked := now.filter("above is not null").count()) > 0:
        below = now.filter("above is not null").groupBy(F.col("above").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("n"))
        # the path above the path above; many paths may hang on one
        up = below.select("path", "n").join(now.select("path", F.col("above").alias("next")), "path")
        raised = join_hot(now.filter("above is not null").select(F.col("path").alias("own"), F.col("above").alias("path")), up, "path", "n", linked)
        summed = now.join(below.drop("n"), "path", "left").select("path", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        now = stored(summed.join(raised.select(F.col("own").alias("path"), F.col("next").alias("above")), "path", "left"))
    return now.drop("above")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, leaf, worth) with n_leaves and saved_tokens, summed over subtrees."""
    own = nodes.groupBy(F.col("conv_id").alias("path")).agg(F.sum("leaf").alias("leaves"), F.sum("worth").alias("saved"))
    tops = nodes.filter("parent_conv_id is null or parent_conv_id <> conv_id").select(F.col("conv_id").alias("path"), F.col("parent_conv_id").alias("above"), (F.col("depth") - 1).alias("at"))
    linked = stored(tops.join(own, "path"))
    total = stored(_path_totals(linked.drop("at")))
    hanging = linked.select("path", "above", "at").join(total, "path").filter("above is not null").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    value = nodes.join(hanging, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaf") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("worth") + F.coalesce("s", F.lit(0))).drop("l", "s", "leaf", "worth")
    upward = Scan(value, "conv_id", [F.col("conv_id"), F.desc("depth")], {"leaves": False, "saved": False})
    rest = [c for c in value.columns if c not in ("conv_id", "leaves", "saved")]
    kinds = dict(value.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", *rest)) + ", n_leaves long, saved_tokens long"

    step = lambda a, _: {**a, "n_leaves": a["run_leaves"], "saved_tokens": a["run_saved"]}
    return upward.map(step, rest, schema)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations)
    turns = stored(turns)
    tries, parts = partial_tries(turns)
    inner = merged(tries, parts)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count("*").alias("members"), F.min("conv_id").alias("least")).filter("members > 0").select(zero.alias("h1"), zero.alias("h2"), zero.alias("depth"), none.alias("p1"), none.alias("p2"), zero.alias("chars"), "members", "least")
    nodes = stored(inner.select(root.columns).unionByName(root))
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    key = ["h1", "h2", "depth"]
    full = stored(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    # each node's parent: a parent may have children without number
    many = full.filter("n_children > 0").select(F.struct(*key).alias("up"), F.col("least").alias("parent_conv_id"), "n_children")
    below = full.filter("depth > 0").select(F.struct(F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("depth") - 1).alias("depth")).alias("up"), *key)
    parents = join_hot(below, many, "up", "n_children", full.count()).select(*key, "parent_conv_id")
    hashed = hashed_ends(_pieces(tries, convs, turns))
    known = full.join(parents, key, "left").join(hashed, ["h1", "h2"], "left")
    plain = known.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("members") - 1) * F.col("chars")).alias("worth"),
    )
    done = _rolled_up(stored(plain))
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


