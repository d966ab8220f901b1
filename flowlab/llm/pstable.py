"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions, shifted and quantised;
several quantised projections together are a bucket key, in several tables. Vectors that
meet in a bucket of any table form candidate components, in which cosines are exact, in
double precision.

Equal vectors of one label are one node, which is hashed and compared once; links count
the vec_ids behind the nodes.

Cases: only equal, non-null labels are compared. A vector that is null, zero, or holds a
null, NaN or infinite component links with nothing; so does one of another width than its
partner. Any other vector is scaled by its largest component first, so that no square
overflows or vanishes. Rows repeating a vec_id are one row of the result: with an equal
vector and label they are one, with different ones the vec_id links with whatever any of its
vectors links with, each other vec_id counted once. Rows with a null vec_id are returned unlinked and
kept. The smallest vec_id names a component. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.blocks import candidate_components, heads_of, in_blocks, per_task
from flowlab.llm.components import components
from flowlab.llm.text import U64, scramble
from flowlab.session import materialise

THRESHOLD = 0.98
#: A pair at the threshold (distance 0.2) shares one projection's cell with probability 0.867,
#: all of a table with 0.136, and some table with 0.999. Unrelated vectors of 64 dimensions
#: share a table with about 1e-7.
CELL = 1.2
PROJECTIONS = 14
TABLES = 48
_SEED = 7


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of the lists of ``column`` as doubles (null: NaN), and where each list begins."""
    values = column.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)
    return flat, column.offsets.to_numpy()


def _unit(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one width divided by their norms, and which of them are usable."""
    rows = flat[at[0] : at[-1]].reshape(len(at) - 1, -1)
    with np.errstate(all="ignore"):
        most = np.abs(rows).max(1)
        good = np.isfinite(rows).all(1) & (most > 0)
        rows = rows / np.where(good, most, 1.0)[:, None]
        return rows / np.where(good, np.sqrt((rows * rows).sum(1)), 1.0)[:, None], good


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) rows that can link."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & some)


def _buckets(nodes: DataFrame, cell: float, projections: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            flat, at = _floats(batch.column("embedding"))
            widths = np.diff(at)
            for width in np.unique(widths).tolist():
                if width not in drawn:
                    random = np.random.default_rng((_SEED, width))
                    drawn[width] = random.normal(size=(width, projections * tables)), random.uniform(0, cell, projections * tables)
                directions, shifts = drawn[width]
                for chosen in np.array_split(np.flatnonzero(widths == width), 1 + batch.num_rows // 2048):
                    if not len(chosen):
                        continue
                    rows = np.concatenate([flat[at[i] : at[i + 1]] for i in chosen.tolist()])
                    unit, good = _unit(rows, np.arange(len(chosen) + 1) * width)
                    chosen, unit = chosen[good], unit[good]
                    cells = np.floor((unit @ directions + shifts) / cell).astype(np.int64).view(U64)
                    pick = pa.array(chosen)
                    label = batch.column("label").take(pick).cast(pa.int64()).to_numpy().view(U64)
                    node = batch.column("node").take(pick)
                    for t in range(tables):
                        key = scramble(label + U64((t + 1) * 0x9E3779B97F4A7C15 % 2**64) + U64(width))
                        for k in range(t * projections, (t + 1) * projections):
                            key = scramble(key ^ (cells[:, k] * U64(0xD1342543DE82EF95) + U64(k)))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node], ["key", "node"])

    return nodes.select("node", "label", "embedding").mapInArrow(run, "key long, node long")


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with a digest of label and vector; 0.0 and -0.0 are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _floats(batch.column("embedding"))
            flat, cuts = flat + 0.0, at.tolist()
            heads = [b"%d:" % k for k in batch.column("label").to_pylist()]
            digests = [hashlib.blake2b(h + flat[a:b].tobytes(), digest_size=16).digest() for h, a, b in zip(heads, cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])

    return rows.mapInArrow(run, "vec_id long, label long, embedding array<double>, digest binary")


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label, embedding, singles, multi) and the distinct (vec_id, node, several).

    A vec_id is ``several`` if it has more than one node; ``singles`` counts the others at a
    node, and ``multi`` says whether one of the several is there. Copies are combined
    before either shuffle.
    """
    keyed = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = _named(keyed)
    vectors = keyed.groupBy("digest").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    vectors = materialise(vectors.withColumn("node", F.monotonically_increasing_id()), "vectors")
    own = keyed.select("vec_id", "digest").distinct().join(vectors.select("digest", "node"), "digest").select("vec_id", "node")
    own = materialise(own, "own")
    counts = own.groupBy("vec_id").agg((F.count("*") > 1).alias("several"))
    own = materialise(own.join(counts, "vec_id"), "membership")
    sizes = own.groupBy("node").agg(F.count(F.when(~F.col("several"), 1)).alias("singles"), F.max("several").alias("multi"))
    return materialise(vectors.drop("digest").join(sizes, "node"), "nodes"), own


COMPARED = "node long, links long, head long, mate long"


def _compare(threshold: float):
    """Per node the vec_ids of its partners, and its group here; pairs as such only where a vec_id has several nodes."""

    def work(group: pa.Table) -> pa.RecordBatch:
        group = group.combine_chunks()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        node, label, own, singles, multi = (
            group.column(c).to_numpy() for c in ("node", "label", "own", "singles", "multi")
        )
        links, some = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        pairs: list[tuple[int, int]] = []
        mates: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        flat, at = _floats(group.column("embedding").chunk(0))
        widths = np.diff(at)
        order = np.argsort(node, kind="stable")
        for width, kind in {(w, k) for w, k in zip(widths.tolist(), label.tolist(), strict=True)}:
            members = order[(widths[order] == width) & (label[order] == kind)]
            rows = np.concatenate([flat[at[i] : at[i + 1]] for i in members.tolist()])
            unit, good = _unit(rows, np.arange(len(members) + 1) * width)
            a, b = np.flatnonzero((own[members] == low) & good), np.flatnonzero((own[members] == high) & good)
            near = unit[a] @ unit[b].T >= threshold
            if low == high:
                near &= a[:, None] < b[None, :]
            i, j = np.nonzero(near)
            x, y = members[a[i]], members[b[j]]
            np.add.at(links, x, singles[y])
            np.add.at(links, y, singles[x])
            some[x] = some[y] = True
            pairs += zip(x.tolist(), y.tolist(), strict=True)
            kept = multi[x] | multi[y]
            mates += [np.stack([node[x[kept]], node[y[kept]]], 1), np.stack([node[y[kept]], node[x[kept]]], 1)]
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        heads = heads_of(len(node), ((int(place[x]), int(place[y])) for x, y in pairs))
        head = node[order][np.array(heads, np.int64)][place] if len(node) else node
        met = np.concatenate(mates)
        mate = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(met[:, 1])])
        columns = [np.concatenate([c[some], d]) for c, d in ((node, met[:, 0]), (links, 0 * met[:, 0]), (head, met[:, 0]))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), mate], [c.split()[0] for c in COMPARED.split(", ")])

    return work


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, cell: float = CELL, projections: int = PROJECTIONS, tables: int = TABLES
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Shuffled are distinct vectors, bucket keys with nodes, and the vectors of candidate components once for each
    block they meet; every node of a bucket is linked to the bucket's smallest only. So the work grows
    with distinct vectors, however many copies they have.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    nodes, own = _nodes(usable(rows))
    near = candidate_components(_buckets(nodes, cell, projections, tables)).withColumnRenamed("node", "met")
    members = near.join(nodes, near.met == nodes.node).select("node", "component", "label", "embedding", "singles", "multi")
    compared = materialise(per_task(in_blocks(materialise(members, "members")), _compare(threshold), COMPARED), "compared")

    # Links of a node: the single vec_ids of its partners, and the vec_ids of several nodes that reach it.
    several = own.where("several").select("vec_id", "node")
    pairs = compared.where("mate is not null").select("node", "mate")
    reach = pairs.join(several.withColumnRenamed("node", "mate"), "mate").select("vec_id", "node").union(several)
    reach = materialise(reach.distinct(), "reach")
    reached = reach.groupBy("node").agg(F.count("*").alias("reached"))
    partners = compared.groupBy("node").agg(F.sum("links").alias("links"))
    counted = nodes.select("node", "singles").join(partners, "node", "left").join(reached, "node", "left")
    others = F.col("singles") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("reached", F.lit(0))
    single = own.where("not several").join(counted, "node").select("vec_id", "node", others.alias("n_links"))
    alone = reach.join(nodes.select("node", "singles"), "node").groupBy("vec_id").agg(F.sum("singles").alias("alone"))
    peers = reach.join(several.withColumnRenamed("vec_id", "peer"), "node").select("vec_id", "peer").distinct()
    peers = peers.groupBy("vec_id").agg((F.count("*") - 1).alias("peers"))
    multiple = alone.join(peers, "vec_id").select("vec_id", (F.col("alone") + F.col("peers")).alias("n_links"))
    first = several.groupBy("vec_id").agg(F.min("node").alias("node"))
    linked = materialise(single.unionByName(multiple.join(first, "vec_id")), "links")

    edges = compared.select(F.col("node").alias("u"), F.col("head").alias("v"))
    edges = edges.union(several.join(first.withColumnRenamed("node", "v"), "vec_id").select(F.col("node").alias("u"), "v"))
    groups = components(edges)
    linked = linked.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = materialise(linked.select("vec_id", "n_links", "component"), "grouped")
    smallest = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    found = linked.join(smallest, "component").select("vec_id", "n_links", "component_id")
    named = rows.where("vec_id is not null").select("vec_id").distinct().join(found, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(nameless).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
