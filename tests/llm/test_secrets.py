import random
import re

from fairload.llm import secrets_dfa as s

BASE = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}
MORE = {
    "github": "gh[oprsu]_[A-Za-z0-9]+",
    "slack": "xox[abprs]-[A-Za-z0-9-]+",
    "google": "AIza[A-Za-z0-9_-]+",
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
LEAST = {"github": 40, "slack": 15, "google": 39, "pem": 0}
PIECES = [
    "password", "PassWd", "secret", "token", "api_key", "apikey", " ", "  ", ":", "=", '"', "'", "abc",
    "deadbeef01", "AKIA", "ABCDEFGH12", "A", "é", "漢", "\n", "0123456789abcdef", "KIA", ".", "-", "gh", "ghp_",
    "-----BEGIN ", "RSA PRIVATE KEY-----", "PRIVATE KEY-----", "passwordtoken", "a" * 11, "xoxb-", "AIza", "x" * 36,
]


def brute(text):
    kinds, out = [*BASE, *MORE], []
    for kind, (pattern, group, least) in BASE.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    for kind, pattern in MORE.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= LEAST[kind]]
    return sorted(out, key=lambda x: (x[1], kinds.index(x[0])))


def test_spans_equal_regular_expressions_on_random_texts():
    scanner, rng = s.Scanner(), random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25)))
        data = text.encode()
        found = s.to_code_points(data, scanner.spans(data))
        rank = [r.kind for r in s.RULES]
        wanted = sorted(brute(text), key=lambda x: (x[1], rank.index(x[0])))
        assert found == wanted, text


def test_combined_automaton_is_minimal_and_small():
    scanner = s.Scanner()
    states = len(scanner.all.table) // 256
    assert states < 5000
    one = s.compile_rules([("hex", "[0-9a-f]{16}[0-9a-f]*", False)], anywhere=True)
    assert len(one.table) // 256 == 17


def test_edge_rows(documents, spark):
    docs = documents([(1, None), (None, "x token = abcdefghijkl"), (2, ""), (2, ""), (3, "é" * 5 + "0123456789abcdef")])
    rows = {(r["doc_id"], r["spans"]) for r in s.scan_secrets(docs).collect()}
    assert s.scan_secrets(docs).count() == 5
    assert rows == {(1, ""), (None, "assign:2:22"), (2, ""), (3, "hex:5:21")}
    assert s.scan_secrets(documents([])).count() == 0


def test_very_long_text(documents):
    docs = documents([(1, "word " * 200_000 + "AKIA" + "Z" * 14)])
    assert s.scan_secrets(docs).first()["spans"] == "access:1000000:1000018"
