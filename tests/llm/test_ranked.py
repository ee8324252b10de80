import math
import random
import re
from collections import Counter

import pytest

from shelf.llm import queries, ranked
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, lower, table


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def brute(docs, items, top=20):
    """(item, rank, score) and the ids of every rank's score, of all documents."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        found += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1)]
    return sorted(found, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    assert rows_of(queries.op12_ranked_search(spark, SMALL)) == brute(docs, items)


def test_edges(spark):
    r = random.Random(3)
    common = "the of and"
    texts = [*TINY_TEXTS, *(f"{common} w{k % 7} " * r.randint(1, 30) for k in range(60)), "rare " + "the " * 5000, "x1 " * 300, "Ünïcode ünïcode ÜNÏCODE"]
    rows = [*enumerate(texts), (None, "w1 w1"), (None, "w1 w1"), (5, "w1 w1"), (70, common), (70, common), (70, common)]
    docs = frame(spark, rows).withColumnRenamed("n", "rank").withColumnRenamed("key", "score")
    asked = [(1, "the the W1"), (2, ""), (3, None), (4, "nobody says this"), (5, "rare x1"), (6, "w1"), (6, "w1"), (7, "ünïcode w3 of"), (None, "w2"), (8, " ")]
    items = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id long, text string, doc_id int")
    want = brute(rows, asked, 5)
    assert rows_of(ranked.ranked_search(docs, items, top=5)) == want
    # queries in several runs, blocks of few documents
    assert rows_of(ranked.ranked_search(docs.repartition(5), items, top=5, query_bytes=12)) == want
    none = ranked.ranked_search(docs.limit(0), items)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
    assert ranked.ranked_search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 2, 3, 5, 100])
def test_levels(most):
    levels = ranked.levels_up_to(most)
    assert levels[0] == 1 and levels == sorted(set(levels)) and levels[-1] <= most


def test_bounds_hold_and_leave_out_most(spark):
    """No document's bound is below its score, and few bounds reach the twentieth score."""
    import xxhash
    import numpy as np
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, "documents").collect()]
    block = {}
    for i, text in docs:
        block.setdefault(8192, ranked._Block(8192))
        if t := ranked.terms_of(text):
            b = block[8192]
            b.doc_ids.append(i), b.hashes.append(0), b.sizes.append(len(t)), b.keys.append(ranked._keys(t, ranked._Hashes()))
    bits, ids, hashes, sizes, slices, n, n_terms = block[8192].row()
    items = [r.text.encode() for r in table(spark, "benchmark").collect()]
    numbers = {}
    asked = [dict(Counter(numbers.setdefault(t, len(numbers)) for t in ranked.terms_of(x))) for x in items]
    df = Counter(t for _, text in docs for t in set(ranked.terms_of(text)))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in numbers], float)
    q = ranked.Queries(asked, np.array([xxhash.xxh3_64_intdigest(t) for t in numbers], np.uint64), weights, n, n_terms)
    texts = dict(docs)
    for k, bound in ranked._bounds({"bits": bits, "doc_ids": ids, "hashes": hashes, "sizes": sizes, "slices": slices}, q):
        exact = np.array([ranked._scored(texts[i], [k], q, numbers)[0][1] for i in ids])
        assert (bound >= exact).all()
        assert (bound >= np.sort(exact)[-20]).mean() < 0.5
