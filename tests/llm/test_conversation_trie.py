"""The conversation trie against a plain trie, over partitions of every cut, and its odd cases."""

import hashlib
import random
import zlib

import pytest

from speciframe.llm import catalog, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, node string, part string, depth string, turns string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            told = f"{len(role or '')}:{role or ''}{text or ''}"
            own.setdefault(conv, []).append(((turn is not None, turn or 0, hashlib.md5(told.encode()).digest()), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        leader = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(leader, [])[:h] + turns[h:]
    return out


def plain(paths):
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + ((len(of) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(paths[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children.get(node, 0), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def answer(spark, rows, tmp_path, parts=None):
    spark.createDataFrame([r + ("x",) * 5 for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if parts:
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = catalog.QUERIES["op12_conversation_trie"](spark, str(tmp_path))
        assert df.columns == COLUMNS
        return sorted([tuple(r) for r in df.collect()], key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def family(rng, n, words, longest):
    """Conversations that copy beginnings and whole others of their kind."""
    made = []
    for _ in range(n):
        start = list(rng.choice(made))[: rng.randrange(longest)] if made and rng.random() < 0.7 else []
        more = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", "é🙂", *words])) for _ in range(rng.randrange(4))]
        made.append((start + more) or [("user", "only")])
    return made


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_random_families_over_partitions(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = []
    for c, turns in enumerate(family(rng, 260, ["a", "bb", "ccc"], 9)):
        order = list(range(len(turns)))
        rng.shuffle(order)
        rows += [(c * 3, None if i == 0 and c % 2 else i, *turns[i]) for i in order]
    assert answer(spark, rows, tmp_path, parts) == plain(rebuilt(rows))


@pytest.mark.parametrize("parts", [3, 24])
def test_large_groups_of_copies_and_one_very_long_conversation(spark, tmp_path, parts):
    long = [(i, "user" if i % 2 else "assistant", f"t{i % 7}") for i in range(900)]
    rows = [(700, *t) for t in long] + [(701, *t) for t in long[:880]] + [(702, *t) for t in long]
    for c in range(1000, 1400):  # copies but for what is grafted in front
        rows += [(c, i, "user", f"copy {i}") for i in range(6 + c % 3)]
    for c in range(2000, 2060):  # ends within others
        rows += [(c, i, "system", "s") for i in range(c % 12 + 1)]
    assert answer(spark, rows, tmp_path, parts) == plain(rebuilt(rows))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "", ""), (5, 3, "user", "x"), (5, 3, "user", "y"), (5, 3, "user", "x"),
            (100, 0, "user", "a" * 300_000), (101, 0, "user", "a"), (-7, 0, "user", "neg"), (-300, 1, "a", "b"), (None, 0, "user", "no id"),
            (13, 0, "use", "r:1"), (14, 0, "user", ":1"), (15, 0, "us", "er:1")]
    assert answer(spark, rows, tmp_path, 5) == plain(rebuilt(rows))


def test_turnless_conversations_end_in_the_root(spark, tmp_path):
    rows = [(c, 0, "user", "x") for c in range(1, 40)]  # no leader: what the graft replaces is gone
    got = answer(spark, rows, tmp_path, 3)
    assert got == plain(rebuilt(rows)) and any(r[1] == 0 and r[7] != conversation_trie.NOTHING for r in got)


def test_empty_tables(spark, tmp_path):
    assert answer(spark, [(None, 0, "user", "x")], tmp_path) == []


def test_ends_are_joined_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 2)
    assert list(conversation_trie._pieces([5, 6, 7])) == ["5,6", "7"]
    assert conversation_trie._digest(["5,6", "7"]) == hashlib.sha256(b"5,6,7").hexdigest()


def test_shared_turns():
    a = b"".join(bytes([i]) * 16 for i in range(9))
    for d in range(10):
        b = a[: d * 16] + b"\xff" * 16 + a[d * 16 + 16 :]
        assert conversation_trie.shared(a, b) == d and conversation_trie.shared(a, a[: d * 16]) == d
