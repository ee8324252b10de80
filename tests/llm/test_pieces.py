import random

import numpy as np
import sentencepiece

from shelf.llm import pieces, queries
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, path, table, texts

MODEL = path("piece_bpe_32k.model")
ODD = ["", "  a  b ", "x\ty", "😀 é é ▁x ▁", "a" * 700 + "b" * 90, " ", "\n\n", "日本語 テスト", "   lead", "trail   "]


def test_query_equals_the_library_and_decodes(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in queries.op2_sentencepiece(spark, SMALL).collect()}
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs) and all(r.round_trip for r in rows.values())
    for d in docs:
        assert rows[d.doc_id].piece_ids == library.encode(d.text) and rows[d.doc_id].n_pieces == len(rows[d.doc_id].piece_ids)


def test_random_texts_equal_the_library():
    library, encoder, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Encoder(MODEL), random.Random(1)
    decode = pieces._make_decode(MODEL)
    for text in ODD + ["".join(r.choice("aeithons  \n.,é▁1") for _ in range(r.randint(1, 40))) for _ in range(2000)] + [" " * k + "x" for k in range(40)]:
        ids = encoder.encode(text)
        assert np.frombuffer(ids, encoder.kind).tolist() == library.encode(text), repr(text)
        assert decode(np.frombuffer(ids, encoder.kind))[0] == text.replace("▁", " ")


def test_pieces_are_given_out_before_the_text_ends():
    vocabulary = pieces.Vocabulary(MODEL)
    text = "▁internationalizationofthings" * 200
    assert list(pieces.viterbi(text, vocabulary)) == vocabulary.merged(text[:29]) * 200

    class Watched(str):
        furthest = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Watched.furthest = max(Watched.furthest, at.stop)
            return str.__getitem__(self, at)

    first = next(pieces.viterbi(Watched(text), vocabulary))
    assert first and Watched.furthest <= 4 * vocabulary.longest


def test_edges(spark):
    docs = frame(spark, [*enumerate([*TINY_TEXTS, *ODD]), (None, "no key")]).withColumnRenamed("key", "piece_ids")
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()}
    assert got[0].piece_ids == [] and got[0].decoded == "" and got[1].n_pieces == 0
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in got.values())
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
    assert pieces.decode(docs.selectExpr("doc_id", "cast(null as array<int>) as piece_ids"), MODEL).where("decoded IS NOT NULL").count() == 0


def test_a_smaller_cache_gives_the_same_ids(spark):
    small, large = pieces.Encoder(MODEL, cached=50), pieces.Encoder(MODEL)
    for text in texts(spark, 60):
        assert small.encode(text or "") == large.encode(text or "")
        assert len(small) + len(small.older) <= 100
    assert len(large) > 100
