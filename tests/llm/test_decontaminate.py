import hashlib
import re

import pytest

from shelf.llm import queries
from shelf.llm.decontaminate import contamination
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, lower, table


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = item_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, ids = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out[doc] = (len(w), len(hit), sorted(ids))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    want = brute(docs, [(r.item_id, r.text) for r in table(spark, "benchmark").collect()])
    rows = queries.op10_decontaminate(spark, SMALL).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


@pytest.mark.parametrize("most", [1 << 23, 120])
def test_one_automaton_or_several(spark, most):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"
    items = [(1, long), (2, "Short item"), (3, None), (4, ""), (2, "other text"), (None, "no name here"), (12, "theta iota kappa")]
    texts = [*TINY_TEXTS, f"Zu: {long.upper()}!", "a SHORT, item; short item", "no Name\n here other text", "shortitem short items", long + " " + long, "é short–item short item"]
    docs = frame(spark, [*enumerate(texts), (None, "short item")]).withColumnRenamed("key", "contamination")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.contamination for r in contamination(docs, bench, most=most).collect()}
    want = brute([*enumerate(texts), (None, "short item")], [(i if i is not None else "null", t) for i, t in items if t is not None])
    for key, (n, hit, ids) in want.items():
        assert (got[key].n_words, got[key].n_hit, got[key].items) == (n, hit, ids), key
    first = len(TINY_TEXTS)
    if most > 120:
        assert [(s.start, s.end) for s in got[first].spans] == [(4, 4 + len(long))]
        assert [(s.start, s.end) for s in got[first + 1].spans] == [(2, 25)]
    assert contamination(docs.limit(0), bench).count() == 0
    assert {r.contamination.n_hit for r in contamination(docs, bench.limit(0)).collect()} == {0}


def test_long_text_and_many_items_with_one_window(spark):
    shared = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(60)], "item_id long, text string")
    text = "filler words here " * 60_000 + shared
    got = contamination(frame(spark, [(1, text), (2, "nothing")]), bench, most=600).collect()
    found = {r.doc_id: r.contamination for r in got}
    assert (found[1].n_words, found[1].n_hit) == (180_010, 10) and found[1].items == sorted(str(i) for i in range(60)) and found[2].n_hit == 0
