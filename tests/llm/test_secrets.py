import hashlib
import random
import re

import numpy as np

from hydroframe.llm import secrets
from hydroframe.llm.shared import table
from tests.llm.helpers import ODD_TEXTS

SMALL = "/root/testdata/sf0.001"
HEX = "0123456789abcdef" * 2


#: The rules by regular expressions of their own: name, pattern, group that is measured, least length, what must not stand before.
PLAIN = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN[A-Z ]+PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 1),
]


def either_case(pattern):
    head, rest = pattern[1:].split(")", 1)
    return "(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + rest


def plain_spans(text, only=None):
    out = []
    for k, (kind, pattern, group, least) in enumerate(PLAIN):
        if only is None or kind in only:
            found = re.finditer(either_case(pattern) if kind == "assign" else pattern, text or "", re.ASCII)
            out += [(m.start(), k, kind, m.end()) for m in found if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def hits(text, lanes):
    return secrets.scan(np.frombuffer(text.encode(), np.uint8), secrets.automaton(), lanes)[:2]


def test_automaton_ends_match_regular_expressions():
    rng = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ": ", " ", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678", HEX, "é", "-----BEGIN RSA PRIVATE KEY-----", "gh", "p_", "eyJ", "abcdefghij.", "xoxb-", "0"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        raw = text.encode()
        at, rules = hits(text, 7)
        got = {(int(e) + 1, k) for e, bits in zip(at, rules, strict=True) for k in range(len(secrets.RULES)) if int(bits) >> k & 1}
        want = set()
        for k, (kind, pattern, *_rest) in enumerate(secrets.RULES):
            flag = re.IGNORECASE if kind in secrets.EITHER_CASE else 0
            for e in range(1, len(raw) + 1):
                if re.compile(rf"(?:{pattern})\Z".encode(), flag).search(raw, 0, e):
                    want.add((e, k))
        assert got == want, text


def test_lanes_do_not_change_the_result():
    text = ("x token = '" + HEX * 30 + "' é " + "AKIA" + "Z9" * 40) * 20
    one = hits(text, 1)
    for lanes in (2, 3, 16, 64):
        other = hits(text, lanes)
        assert all((a == b).all() for a, b in zip(one, other, strict=True))


def test_minimal():
    t, acc, _ = secrets.automaton()
    width = len(t) // len(acc)
    rows, _ = secrets.minimise((t.reshape(-1, width) // width).tolist(), acc.tolist())
    assert len(rows) == len(acc)


def test_spans_equal_regular_expressions():
    rng = random.Random(8)
    parts = ["password", "TOKEN", "toKen", "to\u212aen", "\u017fecret", "api_key", "apikey", "secret", "=", "==", ": ", " ", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678", HEX, "é", "\U0001f600", "-----BEGIN RSA PRIVATE KEY-----", "---", "ghp_", "a1" * 9, "eyJ", "abcdefghij.", "xoxb-", "0", "-"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        got = secrets.cut_spans(text.encode(), (1 << len(secrets.RULES)) - 1)
        assert ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in got) == plain_spans(text), text


def test_long_texts_are_scanned_in_blocks(spark, monkeypatch):
    long = ("é" * 50 + " token = '" + HEX * 3 + "' ") * 400 + "a" * 3000 + " AKIA" + "Z9" * 800
    docs = spark.createDataFrame([(0, long), (1, None), (2, "secret=abcdefg"), (3, "x" * 400_000 + HEX)], "doc_id long, text string").coalesce(1)
    want = {r.doc_id: plain_spans(r.text) for r in docs.collect()}
    data = np.frombuffer(long.encode(), np.uint8)
    where, state = [], 0
    for lo in range(0, len(data), 777):
        at, _, state = secrets.scan(data[lo : lo + 777], secrets.automaton(), 5, state)
        where += (at + lo).tolist()
    assert where == hits(long, 1)[0].tolist()
    monkeypatch.setattr(secrets, "BLOCK", 1000)
    assert ",".join(f"{k}:{a}:{b}" for a, _, k, b in secrets.cut_spans(long.encode(), 127)) == want[0]
    monkeypatch.undo()
    got = {r.doc_id: r.s for r in secrets.find_secrets(docs.union(docs)).select("doc_id", secrets.joined(secrets.F.col("spans")).alias("s")).collect()}
    assert got == want


def test_query_equals_brute_force(spark):
    texts = [*ODD_TEXTS, f"é password: '{HEX}'", "Secret=abc", "token = \"abcde", "AKIA" + "A" * 16 + "x", HEX[:23], "passwd=token=secret:abcdef", "ghp_" + "a1" * 12]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int").unionByName(table(spark, SMALL, "documents").selectExpr("doc_id + 1000 AS doc_id", "text", "1 AS spans"))
    want = {r.doc_id: plain_spans(r.text) for r in docs.collect()}
    got = {r.doc_id: r.s for r in secrets.find_secrets(docs).select("doc_id", secrets.joined(secrets.F.col("spans")).alias("s")).collect()}
    assert got == want and sum(bool(v) for v in want.values()) > 3
    assert secrets.find_secrets(docs.where("false")).count() == 0
    base = secrets.op9_secret_scan(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    assert all(r.base_sha256 == hashlib.sha256(plain_spans(texts[r.doc_id], secrets.BASE).encode()).hexdigest() for r in base)
