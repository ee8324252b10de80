import random
import re
from collections import Counter

import numpy as np

from shelf.llm import quality_rules, queries
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, table, words


def brute(text):
    text = text or ""
    w, lines, seen, dup = words(text), text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {k for k, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op6_quality_rules(spark, SMALL).collect()}
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d.doc_id], brute(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_random_texts():
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice(["a", "b ", "c ", "\n", " ", "\t", "é ", "# ", "a b c\n"]) for _ in range(r.randint(0, 60)))
        assert quality_rules.base_stats(text.encode(), text.encode().split()) == brute(text)


def test_held_out_accuracy(spark):
    """Trained on the labels of one table, judged on the labelled documents of a larger one."""
    big = "/root/testdata/sf0.01"
    model = quality_rules.train(table(spark, "documents", big).where("doc_id % 3 <> 0"), table(spark, "labels", big))
    judged = quality_rules.judge(table(spark, "documents", big).where("doc_id % 3 = 0"), model)
    rows = judged.join(table(spark, "labels", big), "doc_id").where("NOT rules.base_failed").select("quality", "rules.kept", "rules.p_good").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)
    # calibrated: the mean probability is near the share of good ones
    assert abs(sum(r.p_good for r in rows) / len(rows) - len(good) / len(rows)) < 0.08


def plain_fit(rows, rounds=60, ridge=1e-6):
    """The same descent and calibration with dictionaries instead of arrays."""
    import math
    train, held = [r for k, r in enumerate(rows) if k % 5 != 4], [r for k, r in enumerate(rows) if k % 5 == 4]
    count = {y: sum(r[1] == y for r in train) for y in (0, 1)}
    w, squares, b, square_b = {}, {}, 0.0, 1e-10
    for _ in range(rounds):
        g, off_sum = {}, 0.0
        for x, y in train:
            off = (1 / (1 + math.exp(-(sum(w.get(i, 0.0) * v for i, v in x.items()) + b))) - y) * 0.5 / count[y]
            off_sum += off
            for i, v in x.items():
                g[i] = g.get(i, 0.0) + off * v
        for i, d in g.items():
            d += ridge * w.get(i, 0.0)
            squares[i] = squares.get(i, 1e-10) + d * d
            w[i] = w.get(i, 0.0) - 0.5 * d / math.sqrt(squares[i])
        square_b += off_sum ** 2
        b -= 0.5 * off_sum / math.sqrt(square_b)
    margins = [(sum(w.get(i, 0.0) * v for i, v in x.items()) + b, y) for x, y in held]
    good, bad = sum(y for _, y in margins), sum(1 - y for _, y in margins)
    slope, shift = 1.0, 0.0
    for _ in range(2000):  # Newton's method in two variables
        a11 = a12 = a22 = 1e-12
        g1 = g2 = 0.0
        for m, y in margins:
            p = 1 / (1 + math.exp(-max(-30, min(30, slope * m + shift))))
            t = (good + 1) / (good + 2) if y else 1 / (bad + 2)
            q = p * (1 - p)
            a11, a12, a22, g1, g2 = a11 + q * m * m, a12 + q * m, a22 + q, g1 + m * (p - t), g2 + p - t
        a11, a22, g1, g2 = a11 + 1e-6, a22 + 1e-6, g1 + 1e-6 * slope, g2 + 1e-6 * shift
        det = a11 * a22 - a12 * a12
        d1, d2 = (a22 * g1 - a12 * g2) / det, (a11 * g2 - a12 * g1) / det
        slope, shift = slope - max(-5, min(5, d1)), shift - max(-5, min(5, d2))
        if max(abs(d1), abs(d2)) < 1e-9:
            break
    return lambda x: 1 / (1 + math.exp(-max(-30, min(30, slope * (sum(w.get(i, 0.0) * v for i, v in x.items()) + b) + shift))))


def test_verdict_equals_a_plain_regression(spark):
    rows = table(spark, "documents").join(table(spark, "labels"), "doc_id").where("quality IN (0, 1)").orderBy("doc_id").collect()
    held = [(quality_rules.features((r.text or "").encode().split()), r.quality) for r in rows]
    model = quality_rules.fit([(i, v, y) for (i, v), y in held])
    plain = plain_fit([(dict(zip(i.tolist(), v.tolist())), y) for (i, v), y in held])
    for r, ((i, v), _) in zip(rows, held):
        p, q = model.probability(model.margin((r.text or "").encode().split())), plain(dict(zip(i.tolist(), v.tolist())))
        assert abs(p - q) < 0.02 and ((p >= 0.5) == (q >= 0.5) or abs(q - 0.5) < 0.02)


def test_sample_is_bounded_in_documents_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_rules, "fit", lambda rows: seen.append(rows))
    docs = frame(spark, [(k % 20 if k % 2 else 0, f"text {k} " * 20) for k in range(4000)] + [(50, "word " * 100_000 + " ".join(map(str, range(50_000))))])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in [*range(20), 50] for _ in range(3)], "doc_id long, quality int, toxic int")
    quality_rules.train(docs, labels, most=10)
    quality_rules.train(docs, labels, most_bytes=20_000)
    assert 3 < len(seen[0]) <= 10  # not all labelled ids are documents
    assert 0 < len(seen[1]) < 21 and sum(i.nbytes + v.nbytes for i, v, _ in seen[1]) <= 20_000


def test_edges(spark):
    rows = [*enumerate(TINY_TEXTS), (None, "plain words of some length " * 30), (77, "u" * 100_000)]
    docs = frame(spark, rows).withColumnRenamed("key", "rules")
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (3, None, 1), (4, 1, 1), (4, 1, 1), (5, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.train(docs, labels) is None and quality_rules.train(docs.limit(0), labels.limit(0)) is None
    got = {r.doc_id: r.rules for r in quality_rules.judge(docs, None).collect()}
    assert all(not r.kept and r.base_failed and r.p_good is None for k, r in got.items() if k is not None)
    assert (got[0].n_words, got[8].n_repeat_words) == (0, 120)
    model = quality_rules.train(table(spark, "documents"), table(spark, "labels"))
    assert quality_rules.judge(docs.limit(0), model).count() == 0
    assert {r.rules.kept for r in quality_rules.judge(docs, model).where("doc_id IS NULL").collect()} <= {True, False}


def test_small_steps_fit_the_same_model(spark, monkeypatch):
    """The driver fetches the sample in parts and fits it by chunks: whatever their sizes, the sums are made in the same order."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    whole = quality_rules.train(docs, labels)
    monkeypatch.setattr(quality_rules, "CHUNK", 3000)
    monkeypatch.setattr(quality_rules, "FETCH_BYTES", 100_000)
    parts = quality_rules.train(docs, labels)
    assert whole is not None and np.array_equal(whole.weights, parts.weights)
    assert (whole.bias, whole.slope, whole.shift) == (parts.bias, parts.slope, parts.shift)
    assert quality_rules.train(docs, labels, most_bytes=0) is None
