"""Every stage of the pipeline against a plain reading of it, on whole small tables."""

import sentencepiece

import corpus_pipeline as pipeline
from shelf.llm import pii
from tests.llm.helpers import SMALL, TINY_TEXTS, path, table
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_jaccard_join import brute as brute_groups
from tests.llm.test_quality_rules import brute as brute_stats


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or ""))


def test_whole_run_equals_the_stages_in_plain_python(spark):
    docs = table(spark, "documents")
    quality = rows_of(pipeline.quality(spark, docs, SMALL))
    for r in quality:
        n, _, _, _, repeated = brute_stats(r["text"])
        assert n >= 50 and 2 * repeated <= n
    groups = brute_groups([(r["doc_id"], r["text"]) for r in quality], 5, 80)
    kept = [r for r in quality if groups[r["doc_id"]][1] == r["doc_id"]]
    assert len(kept) < len(quality)
    hits = brute_items([(r["doc_id"], r["text"]) for r in kept], [(r.item_id, r.text) for r in table(spark, "benchmark").collect()])
    clean = [r for r in kept if hits[r["doc_id"]][1] == 0]
    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    got = rows_of(pipeline.run(spark, SMALL))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in clean]
    for r, before in zip(got, clean):
        text = pii.masked(before["text"].encode(), 0.4)[0].decode()
        assert r["text"] == text and r["n_chars"] == len(text) and r["piece_ids"] == library.encode(text) and r["round_trip"]
        assert not pii.find_pii(text.encode())


def test_each_stage_takes_any_rows(spark):
    texts = [*TINY_TEXTS, "mail a@b.de", "long enough to pass " * 20]
    rows = [(i, t, None, None, None, "x") for i, t in enumerate(texts)] + [(None, "no key", "en", "s", 6, "x")] * 2 + [(3, "one", "en", "s", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out, empty = stage(spark, docs, SMALL), stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0
        assert out.columns[:5] == pipeline.COLUMNS and (k == 4 or len(out.columns) == 5), name
        if name in ("pii", "sentencepiece", "decontamination"):
            assert out.count() == len(rows)
        if name == "ngram_jaccard_join":
            ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
            # 8 and 9 are copies, and so are the rows without a key and the repeated row
            assert ids == [-1, *[i for i in range(len(texts)) if i != 9]]


def test_encoding_and_decoding_run_one_after_the_other(spark):
    docs = spark.createDataFrame([(1, "some words", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = pipeline.encoded(spark, docs, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
