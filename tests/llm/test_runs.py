import hashlib
import random
import zlib

import pytest

from shelf.llm import queries, runs
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, table, words


def brute(sequence, least=12):
    """Every maximal stretch of every period; the smallest period of a stretch counts."""
    n, found = len(sequence), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if sequence[i] != sequence[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and sequence[j] == sequence[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def kept(sequence, found):
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(sequence) if i not in dropped)


@pytest.mark.parametrize("seed", range(4))
def test_random_sequences(seed):
    r = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(0, 5)):
            letters, size, made = r.choice([1, 2, 2, 3, 4, 30]), r.randint(0, 90), []
            while len(made) < size:
                if made and r.random() < 0.4:
                    a = r.randrange(len(made))
                    made += made[a:r.randint(a + 1, len(made))] * r.randint(1, 4)
                else:
                    made += [b"%d" % r.randrange(letters) for _ in range(r.randint(1, 6))]
            texts.append(made[:size])
        least = r.choice([1, 2, 12])
        assert runs.find_runs(texts, least) == [brute(t, least) for t in texts]


def test_words_with_many_runs():
    """Fibonacci words have the most runs; two progressions of one period with a break between them propose many periods."""
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):
        a, b = b, b + a
    assert runs.find_runs([b], 2) == [brute(b, 2)]
    two = [b"a", b"b"] * 20 + [b"a"] + [b"a", b"b"] * 20
    assert runs.find_runs([two], 2) == [brute(two, 2)]
    assert runs.find_runs([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w = words(d.text)
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found, r = brute(w), rows[d.doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(w, found).encode()).hexdigest()
    assert any(r.n_runs for r in rows.values())


def test_edges(spark):
    texts = [*TINY_TEXTS, "ä ö " * 30 + "end", "x " * 200_000, " ".join(str(i) for i in range(100_000)), "a b c d e f a b c d e f"]
    rows = [*enumerate(texts), (None, "ä ö " * 30), (3, "one"), (3, "one")]
    docs = frame(spark, rows).withColumnRenamed("key", "repeats")
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {*docs.columns, "repeats"}
    for r in got:
        w = words(r.text)
        assert r.repeats.n_words == len(w)
        if len(w) < 1000:
            found = brute(w)
            assert [tuple(x) for x in r.repeats.runs] == found and r.repeats.collapsed == kept(w, found)
    long = {r.doc_id: r.repeats for r in got if r.repeats.n_words >= 1000}
    assert [[tuple(x) for x in v.runs] for _, v in sorted(long.items())] == [[(0, 200_000, 1)], []]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    planted = queries.with_runs(frame(spark, [(i, t) for i in range(40) for t in (None, "", "a", "a b c d e f g h")])).collect()
    assert len(planted) == 160 and sum(r.text is None for r in planted) == 40
