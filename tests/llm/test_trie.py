import hashlib
import re
import zlib

import numpy as np
import pytest
from rulewright.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, every=20, most=4):
    """Nodes as a dictionary of prefixes, from rows of (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    if every:
        own = {c: own.get(c - c % every, [])[: zlib.crc32(str(c).encode()) % most] + ts[zlib.crc32(str(c).encode()) % most :] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below, n = children.get(p, []), len(members[p])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(members[p]) if len(own[c]) == len(p))
        leaves, saved = sum(out[c][5] for c in below) or 1, (n - 1) * words + sum(out[c][6] for c in below)
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(str, out.values()))


def invented(seed, n, kinds, most):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(n).tolist():
        for t in range(int(rng.integers(0, most + 1))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3)) if t > 2 else t % 2], f"say {int(rng.integers(0, kinds)) * 'very '}much\tnow"))
    return rows


@pytest.mark.parametrize("shard", [500_000, 60, 7, 1])
def test_same_as_a_dictionary_of_prefixes(spark, shard):
    rows = invented(1, 130, 2, 5) + [(1000 + c, t, "user", "all the same") for c in range(60) for t in range(3)]
    rows += [(2000, t, "user", f"turn {t % 2}") for t in range(150)] + [(2001, t, "user", f"turn {t % 2}" if t < 140 else "other") for t in range(145)] + [(2002, t, "user", f"turn {t % 2}") for t in range(64)]
    rows += [(3001, None, None, None), (3001, None, "a", ""), (3001, 5, "a", " \t\n"), (3001, 5, "a", " \t\n"), (None, 1, "user", "lost"), (3002, 1, "ab", "c"), (3003, 1, "a", "bc"), (3004, 1, "a:", "bc")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, path string").repartition(3)
    got = trie.nodes(trie.rebuilt(trie.turns(df)), shard).select(*NAMES).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    got = trie.prefix_trie(df, shard).select(*NAMES).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, every=0)


def test_turnless_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(41, 0, "user", "gone")] if zlib.crc32(b"41") % 4 else [(42, 0, "user", "gone")]
    c = rows[0][0]
    got = [tuple(r) for r in trie.nodes(trie.rebuilt(trie.turns(spark.createDataFrame(rows, schema)))).select(*NAMES).collect()]
    assert list(map(str, got)) == brute(rows) and (zlib.crc32(str(c).encode()) % 4 == 0 or got[0][:6] == (c, 0, None, 1, 0, 1))
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0


def test_order_and_shared_over_several_blocks():
    rng = np.random.default_rng(0)
    rows = [tuple(rng.integers(0, 2, rng.integers(0, 12)).tolist()) for _ in range(200)]
    rows = list(dict.fromkeys(rows))
    order, shared = trie.order_and_shared(np.array([x for r in rows for x in r]), np.array([len(r) for r in rows]), width=3)
    assert [rows[i] for i in order] == sorted(rows)
    for a, b, n in zip(order[:-1], order[1:], shared[1:]):
        x, y = rows[a], rows[b]
        assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_query_on_all_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in trie.op13_conversation_trie(spark, sf).select(*NAMES).collect()) == brute(rows)
