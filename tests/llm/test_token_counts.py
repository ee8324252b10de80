import random

from tokenizers import Tokenizer

from shelf.llm import queries, token_counts
from shelf.llm.token_counts import CountTree, clean_edits
from shelf.llm.word_ids import WordCounts
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, path, table

VOCABULARY = path("byte_bpe_50k.json")


def whole():
    found = Tokenizer.from_file(VOCABULARY)
    found.encode_special_tokens = True
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for start, end, put in clean_edits(edits, len(text)):
        text = text[:start] + put + text[end:]
    return text


def test_query_equals_counting_whole_texts(spark):
    count = whole()
    docs = table(spark, "documents").withColumn("edits", queries.edits_of("text")).collect()
    rows = {r.doc_id: r for r in queries.op3_token_counts(spark, SMALL).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        after = edited(d.text, [e.asDict() for e in d.edits])
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].n_tokens_edited, rows[d.doc_id].n_chars_edited) == (count(d.text), count(after), len(after))
    long = [r for d in docs if len(d.text) > 5000 for r in [rows[d.doc_id]]]
    assert long and all(r.n_reencoded < r.n_chars_edited / 2 for r in long)


def test_random_edits_one_after_the_other():
    r, count, counts = random.Random(4), whole(), WordCounts(VOCABULARY)
    parts = ["word", " ", "  ", "\n", "\n\n ", "it's", "'", "x,", "é", "12", "<|endoftext|>", "\t", "a b c d e", "  ", "."]
    for _ in range(120):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 250)))
        tree = CountTree.build(text, counts)
        assert tree.tokens[1] == count(text), text
        for _ in range(6):
            start = r.randint(0, len(text))
            end = min(len(text), start + r.choice([0, 1, 5, 60]))
            text, _ = tree.replace(text, start, end, "".join(r.choice(parts) for _ in range(r.randint(0, 8))), counts)
            assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text)), repr(text)


def test_repeated_edits_in_one_place_stay_local():
    count, counts = whole(), WordCounts(VOCABULARY)
    text = " ".join(f"word{i} and some more" for i in range(8000))
    tree, again = CountTree.build(text, counts), []
    for k in range(400):
        text, n = tree.replace(text, 70_000, 70_000, f" put{k} in here", counts)
        again.append(n)
    assert max(again) < 1000 and (tree.chars[1], tree.tokens[1]) == (len(text), count(text))
    while len(text) > 100:  # and removals
        text, n = tree.replace(text, 20, min(len(text), 9000), "", counts)
        assert tree.chars[1] == len(text)
    assert tree.tokens[1] == count(text)


def test_edges(spark):
    rows = [*enumerate(TINY_TEXTS), (None, "no key")]
    edits = "array(struct(0 as start, 2 as end, 'ab ' as put), struct(1 as start, 9 as end, 'overlaps' as put), struct(-5 as start, 0 as end, 'x' as put), struct(cast(null as int) as start, 1 as end, 'y' as put), struct(99999 as start, 99999 as end, cast(null as string) as put))"
    docs = token_counts.build_trees(frame(spark, rows).withColumnRenamed("key", "tree"), VOCABULARY)
    got = {r.doc_id: r for r in token_counts.apply_edits(docs.selectExpr("*", f"{edits} as edits"), VOCABULARY).collect()}
    count, want = whole(), [{"start": 0, "end": 2, "put": "ab "}, {"start": 1, "end": 9, "put": "overlaps"}, {"start": -5, "end": 0, "put": "x"}]
    assert got[0].edited.text is None and got[0].n_tokens == 0 and got[0].edited.n_tokens == 0
    for key, text in rows[1:]:
        after = edited(text, want)
        assert (got[key].n_tokens, got[key].edited.text, got[key].edited.n_tokens) == (count(text), after, count(after))
    assert token_counts.build_trees(frame(spark, rows).limit(0), VOCABULARY).count() == 0
