import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from hydroframe.llm import trie
from tests.llm.helpers import WORD

SCHEMA = "conv_id long, turn int, role string, text string, ids string, `Key.x` int"


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        rebuilt[c] = turns.get(c - base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in under if x)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children(node)), sum(not children(x) for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "v", 1) for r in rows], SCHEMA)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = trie.prefix_trie(trie.rebuilt_conversations(df))
    assert out.columns == columns
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("range_bytes", [200, 1500, 1 << 20])
def test_nodes_equal_those_of_all_prefixes_listed(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(trie, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(5)
    rows = []
    for c in range(-45, 90):
        if c % 20 or c % 3:
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "a  b\nc"])) for t in range(rng.randrange(1, 5))]
    rows += [(c, t, "user", "the same words") for c in range(200, 260) for t in range(3)]  # a third of all conversations is one
    rows += [(301, t, "user", f"long {t // 2}") for t in range(60)] + [(302, t, "user", f"long {t // 2}") for t in range(58)]
    rows += [(300, None, None, "x"), (300, None, "user", None), (300, 0, "b", "y"), (300, 0, "a", "y"), (300, 0, "a", "y"), (None, 1, "user", "z"), (305, 1, "us", "er x"), (306, 1, "user", " x")]
    assert made(spark, rows) == plain_trie(rows)


def test_turnless_and_missing_conversations(spark):
    short = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]  # one turn, which their missing heads replace
    rows = [(c, 0, "user", "gone") for c in short] + [(7, 0, "user", "stays") for _ in range(5)]
    got = made(spark, rows)
    assert got == plain_trie(rows) and any(r[1] == 0 and r[3] == len(set(short) | {7}) for r in got)
    assert made(spark, []) == []
    assert made(spark, rows[:1]) == plain_trie(rows[:1])


def test_layouts_grow_and_paths_split():
    rng = random.Random(6)
    keys = [bytes(rng.choices(range(rng.choice([2, 20, 256])), k=trie.WIDTH * rng.randrange(4))) for _ in range(3000)]
    keys += [k + bytes([b]) * trie.WIDTH for k in keys[:20] for b in range(256)]
    tree = trie.RadixTree()
    for n, key in enumerate(keys):
        node = tree.node(key)
        node.ends = (node.ends or []) + [n]
    rooms, found, todo = set(), {}, [(b"", tree.top)]
    while todo:
        before, node = todo.pop()
        whole = before + node.path
        rooms.add(node.room)
        found |= {whole: node.ends} if node.ends else {}
        own = list(node.children())
        assert [b for b, _ in own] == sorted(b for b, _ in own) and all(x.path[0] == b and node.child(b) is x for b, x in own)
        assert node.ends or node is tree.top or len(own) > 1  # paths are compressed
        todo += [(whole, x) for _, x in own]
    want = defaultdict(list)
    for n, key in enumerate(keys):
        want[key].append(n)
    assert found == want and rooms == {4, 16, 48, 256}
