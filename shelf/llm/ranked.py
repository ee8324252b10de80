"""Ranked lexical search over bit-sliced Bloom signatures.

Every document sets, for each of its terms and each level of occurrences that the term reaches, a few bits of a
signature. Documents of like size make a block, which keeps its signatures sliced: a row per bit, a bit per document. A
query term's rows, ANDed, are the documents that may hold it as often, more of them than do, never fewer. What the
levels can add, by the documents' lengths and the term's weight, sums up to a bound of each document's score. The best
exact scores known give each query a threshold, and all documents whose bound reaches it are scored exactly.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from shelf.llm.arrow import bounded_batches
from shelf.llm.bits import bitmap, maybe_in
from shelf.llm.recent import Recent
from shelf.session import materialize

#: Signature bits for each key of a document, and how many of them a key sets: about one of 150 absent keys seems there.
BITS_PER_KEY, PROBES = 12, 4
#: Bytes of a block's slices, and documents of one, at most.
BLOCK_BYTES, BLOCK_DOCS = 2 << 20, 2048
#: Query text that one run over the index may hold; more queries are taken in several runs.
QUERY_BYTES = 4 << 20
#: Distinct terms of the queries that are bounded at one time.
GROUP_TERMS = 2048
CACHED, CACHED_LENGTH = 50_000, 64

# Fixed values of the scoring rule.
SCALE, TERM_SCALE, LENGTH_SCALE, LENGTH_SHARE, HUNDRED = 1_000_000_000, 1000, 12, 25, 100

#: Lower-cases A-Z and turns every byte that is in no term into a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = "bits int, doc_ids array<bigint>, hashes array<bigint>, sizes array<bigint>, slices binary, n_docs bigint, n_terms bigint"
COUNTS = "term int, df bigint"
BOUNDS = "query int, doc_id bigint, hash bigint, bound double"
MEETINGS = "doc_id bigint, hash bigint, queries array<int>"
SCORES = "array<struct<query:int,score:bigint>>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def levels_up_to(most: int) -> list[int]:
    """Numbers of occurrences that are told apart: 1, 2, 3, 4, 6, 8, 12, 16, 24 and so on."""
    found, power = [1, 2], 2
    while found[-1] < most:
        found += [power * 3 // 2, power * 2]
        power *= 2
    return [v for v in found if v <= most]


def _mixed(base: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    x = base + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _rows_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The ``PROBES`` slice rows of every key, a column each."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((low[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * high[None, :]) % np.uint64(bits)).astype(np.int64)


class _Hashes(Recent):
    def __init__(self):
        super().__init__(CACHED, CACHED_LENGTH)

    def make(self, term: bytes) -> int:
        return xxhash.xxh3_64_intdigest(term)


def _keys(terms: list[bytes], known: _Hashes) -> np.ndarray:
    """A key of every term and every level that its occurrences reach."""
    counts = Counter(terms)
    base = np.fromiter((known[t] for t in counts), np.uint64, len(counts))
    times = np.fromiter(counts.values(), np.int64, len(counts))
    keys = [base]
    for level in levels_up_to(int(times.max()))[1:]:
        keys.append(_mixed(base[times >= level], level))
    return np.concatenate(keys)


@dataclass
class _Block:
    """Documents whose signatures are ``bits`` long, until there are enough to be written."""

    bits: int

    def __post_init__(self):
        self.doc_ids, self.hashes, self.sizes, self.keys = [], [], [], []
        self.most = max(8, min(BLOCK_DOCS, BLOCK_BYTES * 8 // self.bits))

    def row(self) -> tuple:
        n = len(self.sizes)
        width = -(-n // 8)
        slices = np.zeros(self.bits * width, np.uint8)
        rows = _rows_of(np.concatenate(self.keys), self.bits)
        doc = np.repeat(np.arange(n), [len(k) for k in self.keys])
        cell = rows * width + doc // 8
        mask = np.left_shift(1, doc % 8).astype(np.uint8)
        for k in range(8):  # one bit of a byte at a time, as a byte of several documents is set several times
            one = mask == 1 << k
            slices[cell[:, one].ravel()] |= np.uint8(1 << k)
        return (self.bits, self.doc_ids, self.hashes, self.sizes, slices.tobytes(), n, sum(self.sizes))


def _one_row(row: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)


def _index(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    known, blocks = _Hashes(), {}
    for batch in batches:
        for key, hashed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            if not (terms := terms_of(text.as_py())):
                continue
            keys = _keys(terms, known)
            bits = max(64, 1 << (len(keys) * BITS_PER_KEY - 1).bit_length())
            # signatures of half and of three quarters of a power of two spare room
            bits = next(b for b in (bits // 2, bits * 3 // 4, bits) if b >= len(keys) * BITS_PER_KEY)
            block = blocks.setdefault(bits, _Block(bits))
            block.doc_ids.append(key)
            block.hashes.append(hashed)
            block.sizes.append(len(terms))
            block.keys.append(keys)
            if len(block.sizes) >= block.most:
                yield _one_row(blocks.pop(bits).row(), schema)
    while blocks:
        yield _one_row(blocks.popitem()[1].row(), schema)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of all documents that hold a term, written to the shared folder.

    A row has up to 2,048 documents of like numbers of keys: their ids, text hashes and lengths, and
    the slices, which take some 12 bits a key of a document whatever the vocabulary. The size of a block is bounded,
    and a task holds one open block for every size of signature. Null and empty texts and texts without a term are in no block.
    """
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    schema = to_arrow_schema(StructType.fromDDL(BLOCK))
    return materialize(read.mapInArrow(partial(_index, schema=schema), BLOCK))


def _count(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    numbers = shared.value
    wanted, found = numbers.keys(), Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            found.update(wanted & set(terms_of(text.as_py())))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([numbers[t] for t in found], pa.int32()), pa.array(found.values(), pa.int64())], schema=schema)


@dataclass
class Queries:
    """Queries of a run: each one's terms by number with their repeats, and what the corpus says of the terms."""

    rows: list[dict[int, int]]
    hashes: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int

    def factor(self, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How much so many occurrences in a document of such a length count."""
        return (SCALE * times) // np.maximum(1, TERM_SCALE * times + LENGTH_SCALE * length)

    def length(self, size: int) -> int:
        """A document's length against the corpus' mean, in hundredths."""
        return HUNDRED - LENGTH_SHARE + (LENGTH_SHARE * size * self.n_docs) // self.n_terms

    def groups(self) -> Iterator[tuple[list[int], np.ndarray]]:
        """(queries, their distinct terms) in groups of bounded size; a longer query is a group of its own."""
        held, terms = [], set()
        for q, row in enumerate(self.rows):
            if held and len(terms | row.keys()) > GROUP_TERMS:
                yield held, np.array(sorted(terms))
                held, terms = [], set()
            held.append(q)
            terms |= row.keys()
        if held:
            yield held, np.array(sorted(terms), np.int64)


def _bounds(block: dict, queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
    """(query, bounds of the block's documents), for queries that some document may answer."""
    n, bits = len(block["sizes"]), block["bits"]
    slices = np.frombuffer(block["slices"], np.uint8).reshape(bits, -1)
    sizes = np.array(block["sizes"], np.int64)
    length = np.array([queries.length(s) for s in block["sizes"]], np.int64)
    levels = levels_up_to(int(sizes.max()))
    gains, before = [], np.zeros(n, np.int64)
    for level, following in zip(levels, [*levels[1:], None]):
        most = sizes if following is None else np.minimum(sizes, following - 1)
        after = np.maximum(before, queries.factor(most, length))
        gains.append((after - before).astype(np.float64))
        before = after
    for held, terms in queries.groups():
        if not len(terms):
            continue
        adds = np.zeros((len(terms), n))
        there, alive = None, np.arange(len(terms))
        for level, gain in zip(levels, gains):
            base = queries.hashes[terms[alive]]
            rows = _rows_of(base if level == 1 else _mixed(base, level), bits)
            met = slices[rows[0]]
            for k in range(1, PROBES):
                met &= slices[rows[k]]
            if there is not None:  # who has a term so often has it less often as well
                met &= there
            some = met.any(axis=1)
            alive, there = alive[some], met[some]
            if not len(alive):
                break
            adds[alive] += np.unpackbits(there, axis=1, count=n, bitorder="little") * gain
        place = {t: k for k, t in enumerate(terms.tolist())}
        for q in held:
            row = queries.rows[q]
            at = [place[t] for t in row]
            if at:
                yield q, (queries.weights[list(row)] * np.array(list(row.values()), np.float64)) @ adds[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _seeds(batches: Iterator[pa.RecordBatch], shared, top: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents of the highest bounds of each block and query."""
    for block in _blocks(batches):
        columns: list[list] = [[], [], [], []]
        for q, bound in _bounds(block, shared.value):
            best = np.argpartition(-bound, top - 1)[:top] if len(bound) > top else np.arange(len(bound))
            for d in best[bound[best] > 0].tolist():
                for column, value in zip(columns, (q, block["doc_ids"][d], block["hashes"][d], float(bound[d]))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _meetings(batches: Iterator[pa.RecordBatch], shared, least, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Every document with the queries whose threshold its bound reaches."""
    thresholds = least.value
    for block in _blocks(batches):
        asked = defaultdict(list)
        for q, bound in _bounds(block, shared.value):
            for d in np.flatnonzero(bound >= thresholds[q]).tolist():
                asked[d].append(q)
        columns = ([block["doc_ids"][d] for d in asked], [block["hashes"][d] for d in asked], list(asked.values()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _scored(text: bytes | None, asked: list[int], queries: Queries, numbers: dict[bytes, int]) -> list[tuple[int, int]]:
    terms = terms_of(text)
    length, weights = queries.length(len(terms)), queries.weights
    worth = {}
    for term, times in Counter(terms).items():
        if (t := numbers.get(term)) is not None:
            worth[t] = int(weights[t]) * ((SCALE * times) // (TERM_SCALE * times + LENGTH_SCALE * length))
    return [(q, sum(worth[t] * repeats for t, repeats in queries.rows[q].items() if t in worth)) for q in asked]


def _make_scores(shared, numbers):
    kind = to_arrow_type(StructType.fromDDL(f"s {SCORES}")["s"].dataType)

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        queries, terms = shared.value, numbers.value
        for text, asked in columns:
            yield pa.array([_scored(t.as_py(), q, queries, terms) for t, q in zip(text.cast(pa.binary()), asked.to_pylist())], type=kind)

    run.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SCORES)


def _exact(docs: DataFrame, meetings: DataFrame, shared, numbers) -> DataFrame:
    """(query, doc_id, score) of the documents and queries of ``meetings``, scores above 0. Other texts are not shuffled."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "hash")
    asked = meetings.select(name.alias("name"), "queries")
    known = maybe_in(docs.withColumn("name", name), "name", bitmap(asked, "name"))
    met = known.join(asked, "name").select("doc_id", F.explode(_make_scores(shared, numbers)("text", "queries")).alias("s"))
    return met.select("s.query", "doc_id", "s.score").where("score > 0")


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search(docs: DataFrame, index: DataFrame, texts: list[bytes], top: int, n_docs: int, n_terms: int) -> DataFrame:
    """(query, rank, doc_id, score) for the queries of one run, numbered as in ``texts``."""
    context = docs.sparkSession.sparkContext
    numbers: dict[bytes, int] = {}
    rows = [dict(Counter(numbers.setdefault(t, len(numbers)) for t in terms_of(text))) for text in texts]
    shared_numbers = context.broadcast(numbers)
    counted = docs.select("text").mapInArrow(partial(_count, shared=shared_numbers, schema=to_arrow_schema(StructType.fromDDL(COUNTS))), COUNTS)
    df = np.zeros(len(numbers), np.int64)
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the queries
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.float64)
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in numbers], np.uint64)
    shared = context.broadcast(Queries(rows, hashes, weights, n_docs, n_terms))

    # the documents of the highest bounds, scored exactly, give each query a score that twenty documents reach
    bounds = index.mapInArrow(partial(_seeds, shared=shared, top=top, schema=to_arrow_schema(StructType.fromDDL(BOUNDS))), BOUNDS)
    high = Window.partitionBy("query").orderBy(F.desc("bound"), "doc_id", "hash")
    seeds = bounds.withColumn("at", F.row_number().over(high)).where(F.col("at") <= 2 * top)
    first = materialize(_best(_exact(docs, seeds.groupBy("doc_id", "hash").agg(F.collect_set("query").alias("queries")), shared, shared_numbers), top))
    reached = {r.query: r.score for r in first.where(F.col("rank") == top).select("query", "score").collect()}  # a row for each query
    least = context.broadcast(np.array([max(1, reached.get(q, 1)) for q in range(len(texts))], np.float64))

    meetings = index.mapInArrow(partial(_meetings, shared=shared, least=least, schema=to_arrow_schema(StructType.fromDDL(MEETINGS))), MEETINGS)
    # repeated rows have one signature and one list
    asked = meetings.groupBy("doc_id", "hash").agg(F.first("queries").alias("queries"))
    return _best(_exact(docs, materialize(asked), shared, shared_numbers), top)


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item``, rank, ``key`` and score of the ``top`` documents of every query, scores above 0 only.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A
    query's score of a document sums, over the query's terms, repeats included, the term's weight (by how few
    documents hold it) times what its occurrences count in a document of that length. Equal scores
    rank by ascending key, null keys last. Null and empty texts have no terms: such documents are
    never found, such queries find nothing. Every row of ``queries`` is a query of its own, so a repeated
    row is answered again; every row of ``docs`` is a document. Other columns are left out.

    The queries' size is measured first: they are broadcast, ``query_bytes`` of text at a time. The documents are
    indexed once; no document is left out but by its bound.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text")).where("text IS NOT NULL")
    index = build_index(docs, key, text)
    totals = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    asked = queries.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // query_bytes))
    found = spark.createDataFrame([], StructType([*asked.select("item").schema, *StructType.fromDDL("rank int, doc_id bigint, score bigint")]))
    for part in range(parts if totals.d else 0):
        rows = asked.where("text IS NOT NULL").where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()  # of bounded size
        rows.sort(key=lambda r: (str(r.item), r.text))
        best = _search(read, index, [r.text.encode() for r in rows], top, totals.d, totals.t)
        names = spark.createDataFrame([(q, r.item) for q, r in enumerate(rows)], StructType([*StructType.fromDDL("query int"), *asked.select("item").schema]))
        found = found.unionByName(best.join(names, "query").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return found.select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key), "score")
