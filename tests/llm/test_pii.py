import hashlib
import random
import re

from shelf.llm import pii, queries
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(c) * 2 if n % 2 else int(c) for n, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in PATTERNS.items() for m in re.finditer(p, text or "", re.A) if holds(kind, m[0])]


def test_query_equals_patterns_over_whole_texts(spark):
    rows = {r.doc_id: r for r in queries.op8_pii(spark, SMALL).collect()}
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(",".join(brute(d.text)).encode()).hexdigest()
    assert sum(r.n_email for r in rows.values()) > 0


def test_random_texts():
    r = random.Random(2)
    parts = ["a.b", "@", "x-1", ".", "com", " ", "1", "23", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+49", "(0)", "-", "é", "9" * 17, "0", "%"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        got = [f"{k}:{a}:{b}" for k, a, b, _ in pii.find_pii(text.encode()) if k != "iban"]
        want = [":".join((k, str(len(text[:int(a)].encode())), str(len(text[:int(b)].encode())))) for k, a, b in (x.split(":") for x in brute(text))]
        assert got == want, text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 300_000, "A1" * 100_000):
        pii.find_pii(text.encode())


def test_ibans_before_other_words():
    plain, spaced, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    unlisted = "QQ" + str(98 - int("1" * 14 + "262600") % 97).zfill(2) + "1" * 14
    for iban in (plain, spaced, other, unlisted):
        for tail in ("", ".", " BIC COBADEFF", " 2024", " I", " 1", " 500 EUR", " AB12 CDEF", " AND SO ON", f" {other}", " DE89 3704"):
            text = f"TO AB12 {iban}{tail}".encode()
            got = [text[a:b].decode() for kind, a, b, _ in pii.find_pii(text) if kind == "iban"]
            assert got == [iban] + [other] * (tail == f" {other}"), (text, got)
    for text in (plain + "0", plain + "x", "X" + plain, plain[:-1], plain[:-1] + "1 BIC COBADEFF", "AB12 " * 9):
        assert not [s for s in pii.find_pii(text.encode()) if s[0] == "iban"], text


def test_checksums_context_masks_and_edges(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    rows = [*enumerate([*TINY_TEXTS, f"é bank account {iban}.", "DE89 3704 0044 0532 0130 01", "call +49 30 123456 now", "mail a@b.de, a@b.de"]), (None, "x@y.org")]
    docs = frame(spark, rows).withColumnRenamed("key", "pii")
    got = {r.doc_id: r.pii for r in pii.find(docs).collect()}
    n = len(TINY_TEXTS)
    assert [(s.kind, s.start, s.end) for s in got[n]] == [("iban", 15, 15 + len(iban))] and got[n][0].score == 1.0
    assert not [s for s in got[n + 1] if s.kind == "iban"] and got[n + 2][0].score == 0.8 and got[0] == []
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[n + 3] == "mail [EMAIL], [EMAIL]" and masked[0] is None and masked[1] == "" and masked[3] == "one" and masked[None] == "[EMAIL]"
    assert pii.find(docs.limit(0)).count() == 0 and pii.mask(docs.limit(0)).count() == 0


def test_whole_words_of_four_languages_decide():
    def score(text):
        return [(k, s) for k, _, _, s in pii.find_pii(text.encode())]

    assert score("shipping to 10.1.2.3") == [("ip", 0.6)] and score("hotel +49 30 123456") == [("phone", 0.6)]
    assert score("the server 10.1.2.3") == score("Rechner: 10.1.2.3") == score("serveur 10.1.2.3") == score("servidor 10.1.2.3") == [("ip", 0.8)]
    assert score("release version 1.2.3.4") == score("Kapitel 1.2.3.4") == [("ip", 0.3)]
    assert score("server version 1.2.3.4") == [("ip", 0.5)]
    # a word that the bound of 40 bytes cuts is not seen
    assert score("10.1.2.3" + " " * 36 + "serverless") == [("ip", 0.6)]
    assert pii.masked(b"release version 1.2.3.4" + b" " * 50 + b"host 5.6.7.8", pii.LEAST) == (b"release version 1.2.3.4" + b" " * 50 + b"host [IP]", 1)


def test_planted_spans_are_masked_and_others_stay():
    r = random.Random(9)
    planted, decoys = 0, 0
    for k in range(600):
        ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
        phone = f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)} {r.randint(100, 999)}"
        before = r.choice(["", "unser Rechner ", "call ", "plain words ", "téléphone ", "correo ", "hotel "])
        value = r.choice([ip, phone, f"user{k}@mail{k}.org"])
        text, n = pii.masked(f"{before}{value} and more".encode(), pii.LEAST)
        planted += n == 1 and value.encode() not in text
        decoy = r.choice([f"version {ip}", f"Ausgabe {ip}", f"chapitre {ip}", f"sección {ip}", f"Rechnung {phone}", f"pedido {phone}"])
        decoys += pii.masked(f"die {decoy} x".encode(), pii.LEAST)[1] == 0
    assert planted == 600 and decoys == 600
