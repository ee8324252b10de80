"""Token files: ids of all documents end to end, the documents' boundaries as Elias-Fano lists."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelf.llm.arrow import bounded_batches
from shelf.llm.elias_fano import EliasFano
from shelf.llm.word_ids import WordIds

#: Ids of a segment, and documents of one, after which it is closed; a document is never cut.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 14
SEGMENT = ("shard int, segment int, ids_before bigint, n_docs int, n_ids bigint, id_bytes int, doc_ids array<bigint>, "
           "low_bits int, low binary, high binary, samples binary, ids binary")
ENTRY = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint"
ENTRY_WITH_IDS = ENTRY + ", ids array<int>"


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    words = WordIds(path)
    width, end = words.kind.itemsize, np.array([end_id], words.kind).tobytes()
    shard, segment, before = TaskContext.get().partitionId(), 0, 0
    keys: list[int | None] = []
    ids: list[bytes] = []
    held = 0

    def close() -> pa.RecordBatch:
        bounds = EliasFano.encode(np.cumsum([len(x) // width for x in ids]))
        row = (shard, segment, before, len(keys), held, width, keys, bounds.low_bits, bounds.low, bounds.high, bounds.samples, b"".join(ids))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            keys.append(key.as_py())
            ids.append(words.encode(text.as_py() or "") + end)
            held += len(ids[-1]) // width
            if held >= SEGMENT_IDS or len(keys) >= SEGMENT_DOCS:
                yield close()
                segment, before, keys, ids, held = segment + 1, before + held, [], [], 0
    if keys:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, then ``end_id``, in ascending order of ``key`` (ties by text, nulls first).

    ``tokenizer`` is a file of the tokenizers library that drops white space. The table at ``path``
    has a row per segment: its documents' keys, their ids end to end (two bytes each where the
    vocabulary allows), and where each document ends as an Elias-Fano list. Documents go to shards
    by ranges of the key; shard, segment and place in the segment give the order. A null text is
    an empty document; a repeated row is written again. Spark's writer commits whole tasks, so a
    task that is lost and run again leaves no second copy.
    """
    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    schema = to_arrow_schema(StructType.fromDDL(SEGMENT))
    ordered.mapInArrow(partial(_segments, path=tokenizer, end_id=end_id, schema=schema), SEGMENT).write.parquet(path)


def _entries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bounds = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
            ends = np.array([bounds.select(i) for i in range(bounds.n)], np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            all_ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(starts + row["ids_before"]),
                       pa.array(ends - starts), pa.array([zlib.crc32(all_ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64())]
            if len(schema) > len(columns):
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(all_ids.view("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the table at ``path``; ``ids`` adds the ids.

    ``start`` counts the ids of all documents before. Each segment knows the ids before it in its
    shard; the shards' totals, a row each, are summed up in their order.
    """
    bounded_batches(spark)
    segments = spark.read.schema(StructType.fromDDL(SEGMENT)).parquet(path)
    kind = ENTRY_WITH_IDS if ids else ENTRY
    found = segments.mapInArrow(partial(_entries, schema=to_arrow_schema(StructType.fromDDL(kind))), kind)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard, not a document
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    columns = ["doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    return found.join(before, "shard").select(*columns)


def document(segment: dict, i: int) -> np.ndarray:
    """The ids of the ``i``-th document of a segment's row, by two selects and one slice."""
    bounds = EliasFano(segment["n_docs"], segment["low_bits"], segment["low"], segment["high"], segment["samples"])
    start = bounds.select(i - 1) if i else 0
    return np.frombuffer(segment["ids"], f"<u{segment['id_bytes']}")[start:bounds.select(i)]


def _documents(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows = [(key, document(row, place).astype("<i4")) for key, place in zip(row["keys"], row["places"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def lookup_tokens(spark: SparkSession, path: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id and ids of the documents of the table at ``path`` whose id is in ``wanted``.

    The segments' lists of keys tell where each document is; only segments that hold one are read, and of
    these each document's two bounds by select. An id that is wanted twice is returned once, one that several
    documents have as often as it has them; null ids and ids that no document has are not returned.
    """
    bounded_batches(spark)
    segments = spark.read.schema(StructType.fromDDL(SEGMENT)).parquet(path)
    places = segments.select("shard", "segment", F.posexplode("doc_ids").alias("place", "doc_id")).where("doc_id IS NOT NULL")
    asked = places.join(wanted.select(F.col(key).cast("long").alias("doc_id")).distinct(), "doc_id")
    # a segment has a bounded number of documents
    at = asked.groupBy("shard", "segment").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("at"))
    met = segments.drop("doc_ids", "ids_before", "n_ids").join(at, ["shard", "segment"]).select(
        "n_docs", "low_bits", "low", "high", "samples", "id_bytes", "ids", F.col("at.doc_id").alias("keys"), F.col("at.place").alias("places"))
    kind = "doc_id bigint, ids array<int>"
    return met.mapInArrow(partial(_documents, schema=to_arrow_schema(StructType.fromDDL(kind))), kind)
