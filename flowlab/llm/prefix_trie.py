"""Conversation prefix trie: nodes by named prefixes, subtree totals by parallel tree contraction.

Turns are numbered by a distributed sort. A rebuilt conversation's prefixes are named by chained
digests: within blocks of turns first, then over the blocks, so that no conversation, however
long, is one task's work turn by turn. Equal names are one node of the trie.

Subtree totals come from contraction in join rounds. *Rake* folds every leaf into its parent.
*Compress* takes nodes with one child out of their chains: the node at the chain's lower end
then hangs from what was above the chain, and its edge remembers what the chain adds. A round
compresses chains within blocks of turns, the next one within blocks of as many blocks, and joins
the paths of different conversations where one goes on in the other, so that the rounds grow
with the logarithm of the depth and no chain is gathered whole. When no node is left, the removed ones come back in the opposite order: each total is that of the node its
chain ended in plus what was remembered.

Cases: null roles and texts are empty. Null turns come first; rows of one conversation with
one turn follow by the digest of role and text, so that copies of a row stand together and
each counts as a turn. A remainder has the sign of its conv_id, as in SQL. Rows without a conv_id
belong to no conversation and are left out. Very long texts are digested whole. An empty table has no conversation, so no node, not even a root.
Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.session import materialise

FAMILY, HEADS = 5, 9
#: Turns of one block of the chained digests.
BLOCK = 64
#: Conversations of one piece of a node's list of ended ones: 2**PIECE ids in a row.
PIECE = 12

#: The root's name.
EMPTY = hashlib.sha256(b"").digest()[:16]


def _digest(whole: Column) -> Column:
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes): a turn's 128-bit digest and the size of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary") for c in ("role", "text"))
    # The role's length first, so that no two turns are written alike.
    whole = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role, text)
    chosen = conversations.where(F.col("conv_id").isNotNull())
    return chosen.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _digest(whole).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes): every conversation's turns from 1.

    Rows are sorted by ranges, so a long conversation spans several tasks; what stands in the
    ranges before is added to its numbers. At most one conversation enters each range from
    before, so that table has no more rows than there are ranges.
    """
    turns = materialise(turns, "digests").withColumn("copy", F.monotonically_increasing_id())
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "copy"]
    ranged = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spot = F.monotonically_increasing_id()
    written = materialise(ranged.select("conv_id", "digest", "bytes", spot.alias("spot")), "turns")
    part = F.shiftright("spot", 33).alias("part")
    spans = written.groupBy(part, "conv_id").agg(F.count("*").alias("n"), F.min("spot").alias("first"))
    spans = materialise(spans, "spans")
    split = spans.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id")
    over = "partition by conv_id order by part rows between unbounded preceding and 1 preceding"
    shifts = spans.join(split, "conv_id").select("part", "conv_id", F.expr(f"sum(n) over ({over})").alias("shift")).where("shift is not null")
    heads = spans.select("part", "conv_id", "first")
    offsets = heads.join(shifts, ["part", "conv_id"], "left").select("part", "conv_id", (F.coalesce("shift", F.lit(0)) - F.col("first")).alias("offset"))
    return written.withColumn("part", part).join(offsets, ["part", "conv_id"]).select("conv_id", (F.col("spot") + F.col("offset") + 1).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes) of all rebuilt turns and (conv_id, length) of all conversations; written.

    Only the first turns of a family's first conversation are copied, at most HEADS - 1 each.
    """
    turns = materialise(turns, "numbered")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    sizes = sizes.select("conv_id", "own", base.alias("base"), wanted.alias("h"))
    bases = sizes.where("conv_id = base").select("base", F.col("own").alias("there"))
    sizes = sizes.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    sizes = materialise(sizes.select("conv_id", "own", "base", "h", "m"), "sizes")
    heads = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0))
    heads = sizes.select("conv_id", "base", "m").join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos <= m")
    tails = turns.join(sizes.select("conv_id", "h", "m"), "conv_id").where("pos > h")
    rows = heads.select("conv_id", F.col("pos").alias("depth"), "digest", "bytes").union(
        tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "digest", "bytes")
    )
    lengths = sizes.select("conv_id", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return rows, lengths


def _chained(rows: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """``rows`` with ``last`` and ``out``: the chained digest before and after each row of its key, in order."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, last binary, {out} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, chain = None, EMPTY
        sha = hashlib.sha256
        for batch in batches:
            before, after = [], []
            columns = [batch.column(k).to_pylist() for k in keys]
            for *key, digest in zip(*columns, batch.column("digest").to_pylist(), strict=True):
                if key != here:
                    here, chain = key, EMPTY
                before.append(chain)
                chain = sha(chain + digest).digest()[:16]
                after.append(chain)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before, pa.binary()), pa.array(after, pa.binary())], [*batch.schema.names, "last", out]
            )

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, above, name): names of the prefix without and with each turn; written.

    A name is the digest of the chain over the full blocks before and the chain within the
    block. The next block starts from the name of the last one's end.
    """
    blocked = rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    inner = materialise(_chained(blocked, ["conv_id", "block"], "depth", "inside"), "chains")
    ends = inner.where(F.col("depth") % BLOCK == 0).select("conv_id", "block", F.col("inside").alias("digest"))
    outer = _chained(ends, ["conv_id"], "block", "before").select("conv_id", (F.col("block") + 1).alias("block"), "before")
    named = inner.join(outer, ["conv_id", "block"], "left").withColumn("before", F.coalesce("before", F.lit(EMPTY)))
    above = F.when((F.col("depth") - 1) % BLOCK == 0, F.col("before")).otherwise(_digest(F.concat("before", "last")))
    return materialise(named.select("conv_id", "depth", "bytes", above.alias("above"), _digest(F.concat("before", "inside")).alias("name")), "prefixes")


def ended(named: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the nodes where conversations end: the digest of their ids in ascending order.

    Ids meet in pieces of bounded length; a node's pieces then pass through its digest one by one.
    """
    last = named.join(lengths, "conv_id").where("depth = length").select("name", "conv_id")
    none = lengths.where("length = 0").select(F.lit(EMPTY).alias("name"), "conv_id")
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = last.union(none).groupBy("name", F.shiftright("conv_id", PIECE).alias("piece")).agg(piece.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sha = None, None
        for batch in batches:
            names, digests = [], []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == here:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    names.append(here)
                    digests.append(sha.hexdigest())
                here, sha = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.binary()), pa.array([sha.hexdigest()])], ["name", "ends_sha256"])

    return pieces.repartition("name").sortWithinPartitions("name", "piece").mapInArrow(run, "name binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str], width: int = BLOCK) -> DataFrame:
    """(name, *values): ``values`` summed over every node's subtree, by rake and compress; written.

    ``nodes`` has name, above (null at a root), path and depth, with one node at most for each
    path and depth, and the values. Chains are found along paths: a path holds nodes that lie on
    one way down from a root without a gap; any such paths give right sums, longer ones fewer rounds.
    """
    kids = nodes.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("name")).agg(F.count("*").alias("live"))
    state = nodes.join(kids, "name", "left").select(
        "name", "above", "path", "depth", F.coalesce("live", F.lit(0)).alias("live"), *values, *[F.lit(0).cast("long").alias(f"edge_{v}") for v in values]
    )
    state = materialise(state, "state")
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not state.isEmpty():
        leaf = F.col("live") == 0
        rounds.append((state.where(leaf).select("name", *values), None))
        # Rake: a parent takes its leaves' totals and keeps count of its other children.
        gifts = state.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("name")).agg(
            F.count_if(~leaf).alias("now"), F.min(F.when(~leaf, F.col("path"))).alias("only"), *[F.coalesce(F.sum(F.when(leaf, F.col(v) + F.col(f"edge_{v}"))), F.lit(0)).alias(f"gift_{v}") for v in values]
        )
        inner = state.where(~leaf).join(gifts, "name")
        # A node whose one child lies on another path may move to that path, by the toss of a coin for each path.
        coin = lambda c: F.xxhash64(c, F.lit(len(rounds))).bitwiseAND(F.lit(1))  # noqa: B023, E731
        moves = (F.col("now") == 1) & F.col("above").isNotNull() & (coin("path") == 0) & (coin("only") == 1)
        inner = inner.select(
            "name", "above", F.when(moves, F.col("only")).otherwise(F.col("path")).alias("path"), "depth", F.col("now").alias("live"),
            *[(F.col(v) + F.col(f"gift_{v}")).alias(v) for v in values], *[f"edge_{v}" for v in values],
        )
        # Compress: nodes with one child that follows on their path within a block.
        block = F.floor(F.col("depth") / width).alias("block")
        along = Window.partitionBy("path", "block").orderBy("depth")
        below, rest = along.rowsBetween(Window.currentRow, Window.unboundedFollowing), along.rowsBetween(Window.unboundedPreceding, -1)
        inner = inner.select("*", block)
        gone = (F.col("live") == 1) & F.col("above").isNotNull() & F.coalesce(F.lead("above").over(along) == F.col("name"), F.lit(False))
        inner = inner.select("*", gone.alias("gone"), *[F.when(gone, F.col(v) + F.lead(f"edge_{v}").over(along)).otherwise(0).alias(f"step_{v}") for v in values])
        # The lower end of each chain, and which chain of the block a row belongs to.
        chain = F.coalesce(F.sum(F.when(~F.col("gone"), 1)).over(rest), F.lit(0))
        inner = inner.select("*", F.first(F.when(~F.col("gone"), F.col("name")), ignorenulls=True).over(below).alias("via"), chain.alias("chain"))
        one = Window.partitionBy("path", "block", "chain")
        down = one.orderBy("depth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        top = one.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        added = {v: F.sum(f"step_{v}").over(down) for v in values}
        edge = {v: F.sum(f"step_{v}").over(top) + F.first(f"edge_{v}").over(top) for v in values}
        size = F.count("*").over(top)
        first = F.first("above").over(top)
        inner = inner.select(
            "name", "path", "depth", "live", "gone", "via",
            F.when(F.col("gone") | (size == 1), F.col("above")).otherwise(first).alias("above"),
            *[F.when(F.col("gone"), added[v]).otherwise(F.col(v)).alias(v) for v in values],
            *[F.when(F.col("gone") | (size == 1), F.col(f"edge_{v}")).otherwise(edge[v]).alias(f"edge_{v}") for v in values],
        )
        after = materialise(inner, "state")
        rounds[-1] = (rounds[-1][0], after.where("gone").select("name", "via", *values))
        state = after.where(~F.col("gone")).drop("gone", "via")
        width = min(width * BLOCK, 1 << 40)
    done = None
    for raked, spliced in reversed(rounds):
        # What hangs below a chain was removed in a later round, so its total is known.
        if done is None:
            done = raked
            continue
        known = done.select(F.col("name").alias("via"), *[F.col(v).alias(f"low_{v}") for v in values])
        back = spliced.join(known, "via").select("name", *[(F.col(v) + F.col(f"low_{v}")).alias(v) for v in values])
        done = materialise(done.union(raked).union(back), "totals")
    return nodes.select("name", *values).limit(0) if done is None else done


def build(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows, lengths = rebuilt(numbered(_turns(conversations)))
    lengths = materialise(lengths, "lengths")
    named = prefixes(rows)
    groups = named.groupBy("name").agg(
        F.first("above").alias("above"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes")
    )
    nothing = F.lit(None).cast("binary").alias("above")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(EMPTY).alias("name"), nothing, F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = materialise(groups.union(root), "nodes")
    kids = nodes.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialise(nodes, "family")
    # A node's smallest member is the path it lies on.
    weighed = nodes.select(
        "name", "above", F.col("conv_id").alias("path"), "depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    sums = subtree_sums(weighed, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(parents, "above", "left").join(sums, "name").join(ended(named, lengths), "name", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")
    )


SQL = """
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, digest) as pos, digest, bytes
  from (
    select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, strlen(coalesce(text, '')) as bytes
    from conversations where conv_id is not null)),
sizes as (select conv_id, count(*) as own from turns group by conv_id),
ids as (
  select s.conv_id, s.own, s.conv_id - s.conv_id % 5 as base,
    xor(list_reduce(
      flatten(list_transform(range(1, length(s.conv_id::varchar) + 1), lambda i: list_concat([ord(substr(s.conv_id::varchar, i, 1))::bigint], list_transform(range(8), lambda z: -1::bigint)))),
      lambda crc, op: case when op >= 0 then xor(crc, op) when crc % 2 = 1 then xor(crc // 2, 3988292384) else crc // 2 end,
      4294967295::bigint), 4294967295) % 9 as h
  from sizes s),
heads as (select i.*, least(h, coalesce(b.own, 0)) as m from ids i left join sizes b on b.conv_id = i.base),
rows as (
  select h.conv_id, t.pos as depth, t.digest, t.bytes from heads h join turns t on t.conv_id = h.base and t.pos <= h.m
  union all
  select h.conv_id, t.pos - h.h + h.m, t.digest, t.bytes from heads h join turns t on t.conv_id = h.conv_id and t.pos > h.h),
keyed as (select *, sha256(string_agg(digest, ',') over (partition by conv_id order by depth)) as key from rows
  union all select conv_id, 0, '', 0, '' from heads),
ends as (select conv_id, max(depth) as depth from keyed group by conv_id),
nodes as (
  select key, depth, min(k.conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(e.conv_id::varchar, ',' order by e.conv_id), '')) as ends_sha256
  from keyed k left join ends e using (conv_id, depth) group by key, depth),
links as (
  select n.key, n.conv_id, n.depth, p.conv_id as parent_conv_id
  from nodes n left join keyed k on k.conv_id = n.conv_id and k.depth = n.depth - 1 left join nodes p on p.key = k.key and p.depth = k.depth),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from links where depth > 0 group by all),
family as (select n.*, l.parent_conv_id, coalesce(c.n_children, 0) as n_children
  from nodes n join links l using (conv_id, depth) left join kids c using (conv_id, depth)),
sums as (
  select k.key, k.depth, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum((f.n_convs - 1) * f.bytes) as saved_tokens
  from family f join keyed k on k.conv_id = f.conv_id and k.depth <= f.depth group by k.key, k.depth)
select f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, f.ends_sha256
from family f join sums s using (key, depth)
"""
