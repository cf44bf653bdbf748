"""Operator 12: the trie of conversation prefixes, built level by level.

A node is a distinct sequence of first turns; its conversations are its members and its name is the smallest of their ids,
which with the depth is unique. Level by level the live conversations are grouped by (parent node, next turn); a group
becomes a node, and its members go on to the next level. A conversation leaves the loop where it ends, or where all
members of its node have the same turns to the end (alone, or copies of each other): what hangs below is a chain, whose nodes
are written down at once. So the loop runs as deep as conversations still part, not as deep as they are long. Then the levels
are joined in reverse: each takes the sums of leaves and savings from the one below. Every level is a written table.

Turns are numbered without bringing a conversation into one task: they are sorted by ranges of (conv_id, turn),
numbered inside a range, and the few conversations that span ranges get an offset for each. Hot nodes are joined as hot
keys after partial aggregation. The SHA-256 of the ids that end at a node has to see them in order; blocks of at most BLOCK
ids are joined in parallel and one task reads a node's blocks as a stream.

Turns are told apart by the SHA-256 of role and text, whole sequences by two independent 64-bit sums of their turns' hashes.

Defined results: rows without conv_id belong to no conversation; turns are ordered by turn (null first), ties by the
digest of role and text, so repeated rows are turns of their own; null role or text is empty; a conversation without turns is
a member of the root; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import folder
from .common import key_join, save

#: Turns of a conversation that may come from another one: at most HEADS - 1, of the first of GROUP ids.
HEADS, GROUP = 9, 5
#: Turns of a sorted range at most, turns that go with a live conversation at a time, ids of a block.
RANGE, STRIDE, BLOCK = 1 << 18, 8, 4096

_TURN = "struct<id:binary,bytes:bigint,rest:bigint>"


def head_of(conv_id: Column) -> Column:
    """How many first turns of a conversation are taken from the first one of its GROUP."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id, bytes, rest, length) with pos from 1 and rest, the bytes of text from this turn on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = save(turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("id"), F.octet_length(text).cast("long").alias("bytes")), "digests")
    ranges = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    order = ["conv_id", "turn", "id"]
    sort = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("turn")
    rows = save(sort.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    here = Window.partitionBy("conv_id", "range").orderBy("at")
    local = rows.select("*", F.row_number().over(here).cast("long").alias("k"), F.sum("bytes").over(here).alias("upto"))
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    spans = spans.select("conv_id", "range", past("n").alias("skip"), past("b").alias("skip_bytes"), F.sum("n").over(whole).alias("length"), F.sum("b").over(whole).alias("total"))
    rest = F.col("total") - F.col("skip_bytes") - F.col("upto") + F.col("bytes")
    return local.join(spans, ["conv_id", "range"]).select("conv_id", (F.col("k") + F.col("skip")).alias("pos"), "id", "bytes", rest.alias("rest"), "length")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size, same) and their turns (conv_id, depth, id, bytes, rest).

    The first h turns come from the conversation conv_id - conv_id % GROUP; a conversation's own first h go. Conversations
    are equal where (size, same) are.
    """
    own = save(ordered_turns(turns), "turns")
    first = F.sort_array(F.collect_list(F.when(F.col("pos") <= HEADS, F.struct("pos", "id", "bytes", "rest"))))
    convs = own.filter(F.col("pos") <= HEADS).groupBy("conv_id").agg(first.alias("first"), F.max("length").alias("length"))
    convs = save(convs.withColumn("h", head_of(F.col("conv_id")).cast("int")), "convs")
    base = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base", "left")
    none = F.expr("CAST(array() AS array<struct<pos:bigint,id:binary,bytes:bigint,rest:bigint>>)")
    joined = joined.withColumn("head", F.slice(F.coalesce("base_first", none), F.lit(1), F.col("h"))).withColumn("after", F.coalesce(F.get("first", F.col("h"))["rest"], F.lit(0)))
    joined = joined.withColumn("gap", F.size("head") - F.col("h")).withColumn("size", F.size("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0)))
    joined = save(joined.select("conv_id", "head", "after", "gap", "size", "length"), "heads")
    head = joined.select("conv_id", "after", "head", F.posexplode("head").alias("i", "t"))
    mine = F.col("t.rest") - F.element_at("head", -1)["rest"] + F.element_at("head", -1)["bytes"] + F.col("after")
    head = head.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.id", "t.bytes", mine.alias("rest"))
    tail = own.filter(F.col("pos") > head_of(F.col("conv_id"))).drop("length")
    tail = key_join(tail, joined.select("conv_id", "gap", "length"), "conv_id", "length", own.count())
    tail = tail.select("conv_id", (F.col("pos") + F.col("gap")).alias("depth"), "id", "bytes", "rest")
    rows = save(head.unionByName(tail), "rebuilt")
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "id")) for seed in (1, 2)]
    same = rows.groupBy("conv_id").agg(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).alias("same"))
    return save(joined.select("conv_id", F.col("size").cast("long").alias("size")).join(same, "conv_id", "left"), "members"), rows


def _with_turns(live: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """live with the turns of the next STRIDE levels."""
    near = rows.filter(F.col("depth").between(depth + 1, depth + STRIDE))
    turn = F.struct("depth", "id", "bytes", "rest")
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"), t["rest"].alias("rest")))
    return live.join(near.groupBy("conv_id").agg(turns.alias("turns")), "conv_id", "left")


def _level(spark, path: str, depth: int, df: DataFrame) -> DataFrame:
    df.write.parquet(f"{path}/depth={depth}")
    return spark.read.schema(df.schema).parquet(f"{path}/depth={depth}")


def _levels(spark, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in like.schema)}, depth bigint").parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined parts of each (conv_id, depth); rows come sorted."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for *at, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if at != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256()
            else:
                state.update(b",")
            state.update(part.encode())
        yield _digests(done)
    if key:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    conv, depth, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], names=["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the rows (conv_id, depth, member)."""
    block = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / BLOCK).alias("block"))
    parts = block.agg(F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("part"))
    parts = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return parts.mapInArrow(_digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    members, rows = rebuilt(turns)
    top = folder(spark)
    groups_at, moved_at, totals_at = f"{top}/groups", f"{top}/moved", f"{top}/totals"
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n > 0")
    live = members.crossJoin(F.broadcast(root.select(F.col("conv_id").alias("node"))))  # one row
    depth, levels = 0, {}
    while True:
        if depth % STRIDE == 0:
            live = save(_with_turns(live.drop("turns"), rows, depth), "live")
        going = live.filter(F.col("size") > depth).withColumn("t", F.get("turns", F.lit(depth % STRIDE))).withColumn("key", F.struct("node", "t.id"))
        n = going.count()
        ended = live.filter(F.col("size") == depth).select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("end"), F.col("conv_id").alias("member"))
        if not n:
            moved = ended
            _level(spark, moved_at, depth, moved)
            break
        grouped = going.groupBy("key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.max("t.bytes").alias("bytes"), F.max("t.rest").alias("rest"), (F.min(F.struct("size", "same")) == F.max(F.struct("size", "same"))).alias("chain"))
        levels[depth + 1] = _level(spark, groups_at, depth + 1, grouped.select("child", F.col("key.node").alias("parent"), "n", "bytes", "rest", "chain", "key"))
        step = save(key_join(going, levels[depth + 1].select("key", "child", "chain", "n"), "key", "n", n).select("conv_id", "size", "same", "turns", F.col("child").alias("node"), "chain"), "step")
        chained = step.filter("chain").select(F.col("node").alias("conv_id"), F.col("size").alias("end"), F.col("conv_id").alias("member"))
        _level(spark, moved_at, depth, ended.unionByName(chained))
        live = step.filter("NOT chain").drop("chain")
        depth += 1

    below = None
    like = "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"
    for d in range(max(levels, default=0), -1, -1):
        if d:
            nodes = levels[d].filter("NOT chain").select(F.col("child").alias("conv_id"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "bytes")
        else:
            nodes = root.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
        if below is not None:
            sums = below.groupBy("parent_conv_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
            nodes = nodes.join(sums.withColumnRenamed("parent_conv_id", "conv_id"), "conv_id", "left")
        else:
            nodes = nodes.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_children", "n_leaves", "below")])
        saved = (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("below", F.lit(0))
        done = nodes.select("conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), saved.alias("saved_tokens"))
        done = _level(spark, totals_at, d, done)
        if d:
            tops = levels[d].filter("chain").select(F.col("parent").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"))
            below = done.select("parent_conv_id", "n_leaves", "saved_tokens").unionByName(tops)

    nodes = _levels(spark, totals_at, done).select("depth", *like)
    if levels:
        chains = _levels(spark, groups_at, levels[1]).filter("chain").join(members.select(F.col("conv_id").alias("child"), "size"), "child")
        chains = chains.select(F.col("child").alias("conv_id"), "parent", "n", F.col("depth").alias("from"), "size", (F.col("size") - F.col("depth") + 1).alias("long"))
        chain = key_join(rows.select("conv_id", "depth", "rest"), chains, "conv_id", "long", rows.count()).filter(F.col("depth") >= F.col("from"))
        chain = chain.select("depth", "conv_id", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"))
        nodes = nodes.unionByName(chain)
    ends = end_digests(_levels(spark, moved_at, moved).select("conv_id", F.col("end").alias("depth"), "member"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends, ["conv_id", "depth"], "left").select("conv_id", "depth", *like[1:], F.coalesce("ends_sha256", empty).alias("ends_sha256"))
