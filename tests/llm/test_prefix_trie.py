import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from grainfold.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 string, level string"


def ordered(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found[conv].append(((turn is not None, turn or 0, md5), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in found.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, inside in members.items():
        subtree = [x for x in members if x[: len(node)] == node]
        children = [x for x in subtree if len(x) == len(node) + 1]
        leaves = [x for x in subtree if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in subtree)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in subtree if x)
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def conversations(seed, n=60):
    rnd = random.Random(seed)
    for c in rnd.sample(range(3 * n), n):
        same = rnd.random() < 0.4
        for turn in range(rnd.choice([1, 2, 3, 12, 14] if not same else [3])):
            yield c, turn, rnd.choice(["user", None]) if not same else "user", "hello" if same or rnd.random() < 0.6 else rnd.choice(["", None, "é", "long " * 9])


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_the_query_equals_brute_force(spark, tmp_path, seed):
    rows = list(conversations(seed))
    rows += [(None, 0, "user", "nobody's"), (500, None, "user", "first"), (500, 3, "a", "tie"), (500, 3, "b", "tie"), (500, 3, "b", "tie"), (10_000, 0, "user", "alone")]
    rows += [(1000, i, "user", f"turn {i}") for i in range(300)] + [(1001 + i, k, "user", f"turn {k}") for i in range(4) for k in range(290 + i)]
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(prefix_trie.op13(spark, str(tmp_path)))
    assert got == brute(rebuilt(ordered(rows)))


def test_as_they_are_and_empty(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (4, 0, "u", "c")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert rows_of(prefix_trie.prefix_trie(docs)) == brute(ordered(rows))
    assert rows_of(prefix_trie.prefix_trie(docs.limit(0))) == []


def test_only_turnless_conversations(spark):
    """A conversation that borrows from an absent one and has no more turns of its own is at the root."""
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    docs = spark.createDataFrame([(c, 0, "u", "a", "x", "y", "z")], SCHEMA)
    assert rows_of(prefix_trie.rebuilt_trie(docs)) == brute({c: []})


def test_many_ends_at_one_node(spark):
    rows = [(c, 0, "u", "a") for c in range(500)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert rows_of(prefix_trie.prefix_trie(docs)) == brute(ordered(rows))
