import random
import string
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelf.llm import queries, token_files
from shelf.llm.elias_fano import EliasFano
from shelf.llm.word_ids import WordIds
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, path, table

VOCABULARY = path("word_bpe_49k.json")


@pytest.mark.parametrize("n,step", [(1, 1), (7, 1), (1000, 3), (1000, 5000), (300, 100000)])
def test_elias_fano_round_trip(n, step):
    r = random.Random(n)
    values = np.cumsum([r.randint(0, step) for _ in range(n)])
    coded = EliasFano.encode(values)
    assert coded.decode().tolist() == values.tolist()
    assert [coded.select(i) for i in range(n)] == values.tolist()
    bits = 8 * (len(coded.low) + len(coded.high))
    assert bits <= n * (3 + max(1, int(values[-1]) // n).bit_length()) + 16
    with pytest.raises(IndexError):
        coded.select(n)


def test_word_ids_equal_whole_texts(spark):
    whole, words = Tokenizer.from_file(VOCABULARY), WordIds(VOCABULARY)
    odd = ["", "It's <|endoftext|> İstanbul ǅ ß ﬁ 12a3", "a b\tc d", "don't.stop, x" * 50, "é é ΑΣ", "日本 語。。"]
    for text in [r.text for r in table(spark, "documents").collect()] + odd:
        assert np.frombuffer(words.encode(text), words.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_words_with_symbols_behind_need_the_model_only():
    whole, words, r = Tokenizer.from_file(VOCABULARY), WordIds(VOCABULARY), random.Random(4)
    words.tokenizer = None
    stems = ["a", "The", "heat", "ÜBÜNG", "qué", "naïve", "schließ", "Thereinble"]
    runs = [*string.punctuation, "$$$", ",***", ".&&&", "<|", "|>", *["".join(r.choices(string.punctuation, k=r.randint(2, 9))) for _ in range(500)]]
    for text in [" ".join(stem + run for stem in stems) for run in runs]:
        assert np.frombuffer(words.encode(text), words.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_query(spark):
    whole, start = Tokenizer.from_file(VOCABULARY), 0
    rows = sorted(queries.op1_token_files(spark, SMALL).collect(), key=lambda r: r.doc_id)
    docs = table(spark, "documents").orderBy("doc_id").collect()
    assert len(rows) == len(docs)
    for r, d in zip(rows, docs):
        ids = np.array(whole.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_segments_and_edges(spark, tmp_path, monkeypatch):
    rows = [(5, t) for t in TINY_TEXTS[:5]] + [(None, "no key"), (1, "first one"), (9, "last")]
    docs, out = frame(spark, rows).repartition(3), str(tmp_path / "ids")
    token_files.write_tokens(docs, out, VOCABULARY, 2)
    got = sorted(token_files.read_tokens(spark, out, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5, 5, 5, 9]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    flat = [i for r in got for i in r.ids]
    segments = sorted((s.asDict() for s in spark.read.parquet(out).collect()), key=lambda s: (s["shard"], s["segment"]))
    assert [i for s in segments for k in range(s["n_docs"]) for i in token_files.document(s, k).tolist()] == flat
    token_files.write_tokens(docs.limit(0), out + "0", VOCABULARY, 2)
    assert token_files.read_tokens(spark, out + "0").count() == 0


def test_lookup_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_DOCS", 3)
    rows, out = [*((i * 2, f"text number {i}") for i in range(40)), (10, "again"), (None, "x"), (81, "very long " * 60_000)], str(tmp_path / "ids")
    token_files.write_tokens(frame(spark, rows).repartition(3), out, VOCABULARY, 2)
    wanted = spark.createDataFrame([(10,), (10,), (81,), (3,), (None,), (0,)], "doc_id long")
    got = sorted((r.doc_id, tuple(r.ids)) for r in token_files.lookup_tokens(spark, out, wanted).collect())
    want = sorted((r.doc_id, tuple(r.ids)) for r in token_files.read_tokens(spark, out, ids=True).collect() if r.doc_id in (10, 81, 0))
    assert got == want and len(got) == 4
