import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from gridtrack.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, d long, path string, pos long"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + t[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += node not in kids
    return sorted(
        (min(m), len(x), min(members[x[:-1]]) if x else None, len(m), kids[x] if x in kids else 0, leaves[x], saved[x], hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == x))).encode()).hexdigest())
        for x, m in members.items()
    )


def fixture(seed, n=400):
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c in (100, 207):
            continue
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "hello", "é" * 20, None])))
    rows += [(200, None, "user", "first of all"), (None, 3, "user", "nobody"), (None, None, None, None), (5000, 1, None, None), (5001, 7, "user", "text " * 50_000)]
    rows += [(901, t, "user", f"turn {t}") for t in range(700)]  # a long one, with one that leaves it late and one that stays
    rows += [(905, t, "user", f"turn {t}") for t in range(650)] + [(905, 650 + t, "user", f"other {t}") for t in range(9)]
    rows += [(907, t, "user", f"turn {t}") for t in range(700)]
    rng.shuffle(rows)
    return [(*r, 1, 2, "x", 3) for r in rows]


def columns(r):
    return (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)


def test_against_brute_force(spark):
    rows = fixture(1)
    got = trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(columns, got), key=str) == sorted(brute(rows), key=str)
    # Positions are those of a preorder: each node's interval holds its subtree, and nothing else.
    assert sorted(r.preorder for r in got) == list(range(1, len(got) + 1))
    inside = defaultdict(int)
    at = {(r.conv_id, r.depth): r for r in got}
    for r in got:
        while r is not None:
            inside[r.conv_id, r.depth] += 1
            up = at[r.parent_conv_id, r.depth - 1] if r.depth else None
            assert up is None or up.preorder < r.preorder <= r.preorder_end <= up.preorder_end
            r = up
    assert all(r.preorder_end - r.preorder + 1 == inside[r.conv_id, r.depth] for r in got)


def test_many_ends_of_one_node(spark, monkeypatch):
    """The list of a node with very many members goes through several pieces and ranges."""
    monkeypatch.setattr(trie, "PIECE", 40)
    rows = [(c, t, "user", "same") for c in range(0, 30000, 100) for t in range(7)]
    got = trie.trie(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)).collect()
    assert sorted(map(columns, got), key=str) == sorted(brute(rows), key=str)


def test_repeated_turns(spark):
    """Rows of one turn are ordered by their digests: whatever the order of the rows, the result is one."""
    rows = [(c, 0, "user", x) for c in (0, 1, 2) for x in ("a", "b", "b")]
    first = sorted(map(columns, trie.trie(spark.createDataFrame(rows, SCHEMA.split(", c ")[0])).collect()), key=str)
    again = sorted(map(columns, trie.trie(spark.createDataFrame(rows[::-1], SCHEMA.split(", c ")[0])).collect()), key=str)
    assert first == again and max(r[1] for r in first) == 3


def test_as_the_sql(spark, tmp_path):
    rows = [(c, None if t is None else t, r, x) for c, t, r, x, *_ in fixture(4, 150) if c is None or c < 900]
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, SCHEMA.split(", c ")[0])
    frame.write.parquet(str(tmp_path / "c.parquet"))
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/c.parquet/*.parquet'")
    assert sorted(map(columns, trie.trie(frame).collect()), key=str) == sorted(con.sql(trie.oracle()).fetchall(), key=str)


def test_empty_table(spark):
    assert trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).count() == 0
