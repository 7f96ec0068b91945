import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelwright.llm import trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """Nodes by the definition: every prefix of every rebuilt conversation in a dictionary."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    key = lambda t: (t[0], t[1].encode(), hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest())
    own = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    nodes = defaultdict(list)
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(paths[c]) + 1):
            nodes[paths[c][:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        todo = [p]
        while todo:
            q = todo.pop()
            yield q
            todo += kids[q]

    out = []
    for p, cs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in cs if paths[c] == p)))
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below(p) if q)
        leaves = sum(not kids[q] for q in below(p))
        out.append((len(p), min(cs), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(df, shard_rows=trie.SHARD):
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(trie.rebuilt(df), shard_rows).collect()), key=repr)


def conversations(n):
    """Chains, wide and deep branching, a third of all conversations alike, shared first turns."""
    rng = random.Random(5)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            rows += [(c, k, "user", f"the same {k}") for k in range(5)]
        else:
            rows += [(c, k, rng.choice(("user", "assistant")), rng.choice(("a", "b b", f"rare {rng.randrange(n)}"))) for k in range(rng.randrange(1, 7))]
    rows += [(n + 20, k, "user", "deep" if k < 60 else str(k)) for k in range(80)] + [(n + 60, k, "user", "deep") for k in range(70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows,ends,most", [(trie.SHARD, 1 << 16, 16 << 20), (7, 20, 16 << 20), (3, 8, 2_000)])
def test_nodes_match_brute_force(spark, monkeypatch, shard_rows, ends, most):
    monkeypatch.setattr(trie, "ENDS", ends)
    monkeypatch.setattr(trie, "SKELETON_BYTES", most)
    monkeypatch.setattr(trie, "BATCH", 5)
    rows = conversations(300)
    assert trie_of(spark.createDataFrame(rows, TURNS), shard_rows) == brute(rows)


def test_nodes_over_a_shard_are_in_the_skeleton(spark):
    paths = [(bytes([a]) * 16 + bytes([b]) * 16, k) for k, (a, b) in enumerate((a, b) for a in range(3) for b in range(40))]
    df = spark.createDataFrame([(c, bytearray(p), [1, 1]) for p, c in paths], "conv_id long, path binary, words array<long>")
    bounds = trie.splitters(df, 10)
    known = trie.Skeleton(bounds)
    shard = lambda key: sum(b <= key for b in bounds)
    for a in range(3):
        over = {shard(k) for k in paths if k[0][:1] == bytes([a])}
        assert len(over) == 1 or (0, bytes([a]) * 16) in known.child
    assert len({shard(k) for k in paths}) == len(bounds) + 1 > 5


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 3, "user", "x"), (-21, 0, "user", "x y"),
            (-20, 0, "user", "x y"), (40, 0, "a", "b"), (41, 0, "", "ab"), (42, 5, "ab", ""), (60, 1, "user", "long " * 50_000), (61, 1, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as path", "2 as words", "'z' as t", "3 as block", "4 as h", "5 as shard", "6 as node")
    assert trie_of(df) == brute(rows)
    alone = spark.createDataFrame([(2, 0, "user", "goes")], TURNS)  # crc32('2') % 4 == 3: nothing of it is left
    assert zlib.crc32(b"2") % 4 > 0 and trie_of(alone) == brute([(2, 0, "user", "goes")]) and len(trie_of(alone)) == 1
    assert trie_of(spark.createDataFrame([], TURNS)) == []
