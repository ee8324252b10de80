import hashlib
import random
import re

from shelf.llm import queries
from shelf.llm.secret_scan import checksum62, find_secrets, scan_secrets
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, table

KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, (pattern, ok)) in enumerate(KINDS.items())
             for m in re.finditer(pattern, text or "", re.A) if ok(m)]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def github(body):
    return "ghp_" + body + checksum62(body.encode()).decode()


def test_query_equals_patterns_over_whole_texts(spark):
    rows = {r.doc_id: r for r in queries.op4_secret_scan(spark, SMALL).collect()}
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = brute(d.text)
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert rows[d.doc_id].n_hex == sum(x.startswith("hex") for x in want)


def test_random_texts():
    r = random.Random(1)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "APIkey", '"', "'", "=", ":", " ", "abcdef1", "x", "AKIA", "AKIA" + "Z" * 16, "0123456789abcdef" * 2,
             "deadbeef", "é", "\n", "-", "abc"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        got = [f"{k}:{a}:{b}" for k, a, b, _ in find_secrets(text.encode())]
        data = text.encode()
        assert got == [":".join((k, str(len(text[:int(a)].encode())), str(len(text[:int(b)].encode())))) for k, a, b in (x.split(":") for x in brute(text))], data


def test_checksums_and_edges(spark):
    good, bad = github("Q" * 30), "ghp_" + "Q" * 36
    rows = [*enumerate([*TINY_TEXTS, f"é {good} {bad}", "token=abcdef " * 2000, "npm_" + "b" * 30 + checksum62(b"b" * 30).decode()]), (None, "secret: abcdefg")]
    docs = frame(spark, rows).withColumnRenamed("key", "secrets")
    got = {r.doc_id: r.secrets for r in scan_secrets(docs).collect()}
    assert len(got) == len(rows) and got[0] == [] and got[1] == []
    n = len(TINY_TEXTS)
    assert [(s.kind, s.start, s.end, s.checked) for s in got[n]] == [("github", 2, 2 + len(good), True)]
    assert len(got[n + 1]) == 2000 and got[n + 2][0].kind == "npm" and got[None][0].kind == "assign"
    assert scan_secrets(docs.limit(0)).count() == 0
