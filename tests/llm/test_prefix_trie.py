from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF
from tickloom.llm import prefix_trie
from tickloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, diff

SCHEMA = "conv_id long, turn int, role string, text string"


def plain_rebuilt(rows: list[tuple]) -> dict:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    base = {c: c - int(np.fmod(c, 5)) for c in own}
    return {c: own.get(base[c], [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def plain_trie(convs: dict) -> list[tuple]:
    """Every prefix of every conversation as a tuple, with the prefixes below it."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    size = {p: len(p[-1][1].encode()) if p else 0 for p in members}
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * size[p]
            leaves[p[:d]] += not children[p]
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, cs in members.items())


def got(df) -> list[tuple]:
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made_up(rng: random.Random, n: int) -> list[tuple]:
    rows = []
    hot = [("user", "hello"), ("assistant", "é" * 30), ("user", "bye")]
    for c in rng.sample(range(5 * n), n):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", ""])) for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))]
        if rng.random() < 0.4:
            turns = hot[: rng.randint(1, 3)] + turns[: rng.choice([0, 0, 2])]
        if rng.random() < 0.05:
            turns += [("user", str(k)) for k in range(150)]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def test_closing_places_and_least_values():
    rng = random.Random(2)
    for _ in range(60):
        bits, depth, opened, size = [], 0, 0, rng.randint(1, 300)
        while opened < size or depth:
            up = opened < size and (not depth or rng.random() < rng.choice([0.5, 0.55, 0.9]))
            bits.append(1 if up else -1)
            opened, depth = opened + up, depth + bits[-1]
        stack, expected = [], {}
        for i, b in enumerate(bits):
            if b == 1:
                stack.append(i)
            else:
                expected[stack.pop()] = i
        opens = np.flatnonzero(np.array(bits) == 1)
        for block in (1, 2, 4, 64):
            assert prefix_trie.find_close(np.cumsum(bits), opens, block).tolist() == [expected[i] for i in opens.tolist()]
    values = np.array([rng.random() for _ in range(57)])
    for _ in range(100):
        a = rng.randint(0, 56)
        z = rng.randint(a + 1, 57)
        assert prefix_trie._least(values, np.array([a]), np.array([z]))[0] == values[a:z].min()


@pytest.mark.parametrize("shard_turns", [1, 40, 200_000])
def test_trie_against_prefixes(spark, shard_turns):
    rows = made_up(random.Random(shard_turns), 260)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", name int").repartition(6)
    convs = prefix_trie.rebuilt(prefix_trie.sequences(df))
    expected = plain_rebuilt(rows)
    assert got(prefix_trie.trie(convs, shard_turns)) == plain_trie(expected)


def test_odd_turns(spark):
    rows = [(0, None, None, None), (0, 1, "user", None), (0, 1, "user", "x"), (0, 1, "user", "x"), (1, 0, "", ""), (2, None, "user", "long " * 100_000), (None, 0, "user", "lost"), (None, None, None, None),
            (3, 0, "a", "bc"), (4, 0, "ab", "c"), (-3, 0, "user", "x"), (-5, 0, "user", "y"), (12, 0, "user", "only")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), 3)) == plain_trie(plain_rebuilt(rows))
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df.limit(0)))).count() == 0


def test_a_hot_class_is_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACKED", 7)
    rows = [(5 * k, t, "user", f"same {t}") for k in range(300) for t in range(2)] + [(5 * k, 0, "user", "other") for k in range(300, 320)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.trie(prefix_trie.sequences(df))) == plain_trie({c: [(r, x) for d, _, r, x in rows if d == c] for c in {r[0] for r in rows}})


def test_query_against_sql(spark):
    con = connect(SF)
    assert diff(QUERIES["op11_conversation_trie"](spark, SF), con.sql(ORACLES["op11_conversation_trie"])) is None
    con.close()
