import math
import zlib
from collections import Counter

import xxhash

from shelf.llm import queries, shards
from tests.llm.helpers import SMALL, TINY_TEXTS, frame, table


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(key, weights):
    best = None
    for shard, weight in enumerate(weights):
        # the engine hashes the columns in turn, each with the hash so far as its seed; an int is four bytes
        h = xxhash.xxh64_intdigest((shard).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(str(key if key is not None else "null").encode(), seed=42))
        u = ((h >> 12) + 0.5) / float(1 << 52)
        best = max(best, (-weight / math.log(u), shard)) if best else (-weight / math.log(u), shard)
    return best[1]


def test_query(spark):
    rows = queries.op9_sharding(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == brute(r.doc_id, [1.0] * 16) and r.grown_shard in (r.shard, 16)
        assert r.grown_shard == brute(r.doc_id, [1.0] * 17)
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_weights(spark):
    got = Counter(r.s for r in spark.range(20000).select(shards.shard_of(queries.F.col("id"), [1.0, 3.0]).alias("s")).collect())
    assert abs(got[1] / 20000 - 0.75) < 0.02


def test_edges(spark):
    rows = [*enumerate(TINY_TEXTS), (None, "x"), (None, None), (1, ""), (1, "other")]
    docs = frame(spark, rows).withColumnRenamed("key", "shard").withColumnRenamed("n", "size")
    got = shards.assign(docs, [1.0] * 3).collect()
    assert len(got) == len(rows)
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert shards.assign(docs.limit(0), [1.0] * 3).count() == 0
