import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlab.llm import prefix_trie as q
from flowlab.sources.tables import table

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [(t[3], t[4]) for t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def sql(rows):
    con = duckdb.connect()
    conv, turn, role, text = zip(*rows, strict=True)
    con.register("conversations", pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string())}))
    return sorted(con.execute(q.SQL).fetchall(), key=lambda r: (r[0], r[1]))


def made_rows():
    """Shared openings, copies, one hot conversation, ties, nulls, gaps, negative ids, turnless rebuilt ones."""
    r = random.Random(3)
    rows = []
    for c in [*range(-7, 30), *range(100, 160), 1003, 1004, 2**40]:
        for t in range(r.randrange(1, 14)):
            rows.append((c, t * 2, r.choice(["user", "assistant", None]), r.choice(["hi", "what?", "é" * 9, "", None])))
    rows += [(40, t, "user", f"long {t % 3}") for t in range(700)]
    rows += [(c, t, "user", f"long {t % 3}") for c in range(60, 72) for t in range(150)]
    rows += [(90, None, "user", "b"), (90, None, "user", "a"), (90, 0, "x", "y"), (90, 0, "x", "y"), (90, -3, None, None), (90, 0, "xy", "")]
    rows += [(None, 1, "user", "no conversation"), (3333, 5, "user", "z" * 200_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_made_conversations(spark, parts):
    rows = made_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    df = df.select("*", *[F.lit("extra").alias(c) for c in ("depth", "name", "above", "pos", "part", "digest", "bytes", "path")])
    expected = brute(rows)
    assert sum(r[2] is None for r in expected) == 1
    assert got(q.build(df)) == expected
    assert sql(rows) == expected


def test_all_conversations(spark, data):
    df = table(spark, data, "conversations")
    expected = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got(q.build(df)) == expected


def test_empty_and_single(spark):
    assert got(q.build(spark.createDataFrame([], SCHEMA))) == []
    assert got(q.build(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    rows = [(3, 0, "a", "b")]  # crc32("3") % 9 is not 0 and there is no conversation 0: turnless
    assert got(q.build(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("shape", ["chain", "comb", "random", "star"])
def test_contraction_of_any_tree(spark, shape):
    """Sums over subtrees of chains, combs, stars and random trees, in blocks of four turns; paths as in a trie."""
    r = random.Random(shape)
    n = 160
    if shape == "chain":
        up = [None, *range(n - 1)]
    elif shape == "comb":
        # The path of each node of the spine goes on in its tooth, not in the spine.
        up = [None, *[i - 1 if i % 2 else max(i - 2, 0) for i in range(1, n)]]
    elif shape == "star":
        up = [None, *[0] * (n - 1)]
    else:
        up = [None, *[r.randrange(i) for i in range(1, n)]]
    depth, path, first = [0] * n, list(range(n)), {}
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
        if up[i] not in first:
            first[up[i]] = i
            path[i] = path[up[i]]
    values = [r.randrange(1000) for _ in range(n)]
    expected = list(values)
    for i in range(n - 1, 0, -1):
        expected[up[i]] += expected[i]
    rows = [(bytes(str(i), "ascii"), None if up[i] is None else bytes(str(up[i]), "ascii"), path[i], depth[i], values[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "name binary, above binary, path long, depth long, v long")
    out = {int(bytes(x.name)): x.v for x in q.subtree_sums(df, ["v"], width=4).collect()}
    assert out == dict(enumerate(expected))
