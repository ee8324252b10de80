"""Quality rules: a logistic regression on hashed word and character n-grams, calibrated, with fixed thresholds."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelf.llm.arrow import bounded_batches, row_udf
from shelf.llm.spans import CONTINUATION
from shelf.session import materialize

#: Buckets of the feature space (a power of two): the broadcast weights take 4 bytes each.
BUCKETS = 1 << 18
#: Labelled documents that the fit reads at most, and bytes of their features, taken by the order of a hash of their id; scoring has no bound.
TRAIN_ROWS, TRAIN_BYTES = 2000, 48 << 20
#: Entries of the sample that a step of the fit works on, and bytes of features that the driver fetches at a time.
CHUNK, FETCH_BYTES = 1 << 19, 4 << 20
#: A text is kept where its calibrated probability of being good is at least this.
KEEP = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
CHAR_NGRAMS = (2, 3, 4)

# Fixed values of the contract.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
PAIR = 0x9E3779B1
#: Powers of an odd number modulo 2 ** 64, for the places of a word's bytes.
POWERS = np.multiply.accumulate(np.full(64, 1_000_003, np.uint64))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in three-word windows found twice or more."""
    if len(ids) < 4 or distinct == len(ids):
        return 0
    if distinct < 2_000_000:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def base_stats(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (len(words), len(text.translate(None, SPACES + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), repeated,
            repeated_words(ids, len(numbers)))


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    """The upper bits of a multiplied hash, so that all its bits count; ``kind`` keeps n-grams of different lengths apart."""
    return ((hashes + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)


def buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the words, their ends marked by a space, and of all words and word pairs."""
    line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    wide, inside = line.astype(np.uint64), line == 32
    rolled, crossing, chars = wide, np.zeros(len(line), bool), []
    for n in range(2, max(CHAR_NGRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(257) + wide[n - 1:]
        crossing = crossing[:-1] | (inside[n - 2:-1] if n > 2 else False)
        if n in CHAR_NGRAMS:
            chars.append(_bucket(rolled[~crossing], n))
    starts = np.flatnonzero(inside)[:-1] + 1
    ends = np.flatnonzero(inside)[1:]
    order = np.arange(1, len(line)) - np.repeat(starts, ends - starts + 1)
    hashed = np.add.reduceat(wide[1:] * POWERS[order % len(POWERS)] * (~inside[1:]), starts - 1)
    return np.concatenate(chars), np.concatenate([_bucket(hashed, 1), _bucket(hashed[:-1] * np.uint64(PAIR) + hashed[1:], 0)])


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: character n-grams by their share of all, words and word pairs by the number of words."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    chars, whole = buckets(words)
    index, place = np.unique(np.concatenate([chars, whole]), return_inverse=True)
    shares = np.concatenate([np.full(len(chars), 1 / len(chars)), np.full(len(whole), 1 / len(words))])
    return index.astype(np.int32), np.bincount(place, shares).astype(np.float32)


@dataclass
class Model:
    """Weights of the buckets, the intercept, and slope and shift of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: float) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def margin(self, words: list[bytes]) -> float:
        if not words:
            return self.bias
        chars, whole = buckets(words)
        return self.bias + float(self.weights[chars].mean(dtype=float) + self.weights[whole].sum(dtype=float) / len(words))


def _chunks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of rows of about ``CHUNK`` entries, or of one longer row."""
    cuts, held = [0], 0
    for k, n in enumerate(sizes):
        if held and held + n > CHUNK:
            cuts.append(k)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], len(sizes)]))


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Adagrad over the whole sample; classes weigh the same. A chunk of rows at a time, added up in the order of the rows."""
    sizes = np.array([len(i) for i, _ in rows])
    chunks = _chunks(sizes)
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b, margin = np.zeros(BUCKETS, np.float32), 0.0, np.zeros(len(rows))
    squares, square_b, every = np.full(BUCKETS, 1e-10), 1e-10, np.arange(BUCKETS)
    for _ in range(rounds):
        g = np.zeros(BUCKETS)
        # rows' margins need the weights of the round only, so one pass does for both
        for first, end in chunks:
            part, filled = sizes[first:end], sizes[first:end] > 0
            index = np.concatenate([i for i, _ in rows[first:end]])
            value = np.concatenate([v for _, v in rows[first:end]])
            # the entries of a row are neighbours
            margin[first:end][filled] = np.add.reduceat(value * w[index], np.concatenate([[0], np.cumsum(part[filled])[:-1]])) if len(index) else 0.0
            off = ((1 / (1 + np.exp(-np.clip(margin[first:end] + b, -30, 30))) - y[first:end]) * weigh[first:end]).astype(np.float32)
            # begins with the sums so far
            g = np.bincount(np.concatenate([every, index]), np.concatenate([g, value * np.repeat(off, part)]), BUCKETS)
        off = (1 / (1 + np.exp(-np.clip(margin + b, -30, 30))) - y) * weigh
        g += ridge * w
        squares += g * g
        w -= (0.5 * g / np.sqrt(squares)).astype(np.float32)
        square_b += off.sum() ** 2
        b -= 0.5 * off.sum() / np.sqrt(square_b)
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with smoothed targets."""
    target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * beta)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 60, ridge: float = 1e-6) -> Model | None:
    """A model from (buckets, values, label), every fifth row held out to calibrate it; None without both classes in each part."""
    y = np.array([r[2] for r in rows], float)
    held = np.arange(len(rows)) % 5 == 4
    if any(len(set(part)) < 2 for part in (y[held], y[~held])):
        return None
    w, b = _descend([r[:2] for r, h in zip(rows, held) if not h], y[~held], rounds, ridge)
    margin = np.array([float((w[i] * v).sum()) + b for (i, v, _), h in zip(rows, held) if h])
    slope, shift = _platt(margin, y[held])
    return Model(w.astype(np.float32), b, slope, shift)


def _featured(text: bytes | None) -> tuple[bytes, bytes]:
    index, value = features(text.split() if text else [])
    return index.tobytes(), value.tobytes()


def _make_features():
    return _featured


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fit on at most ``most`` labelled documents, whole texts, whose features are hashed on the executors.

    Rows without a key, text or label of 0 or 1 teach nothing. A key that is labelled several times has its
    smallest label, one of several texts its smallest text, so a repeated row counts once. Of the sample the driver
    reads as many documents, in the order of their keys' hashes, as have ``most_bytes`` of features. None where a class is missing.
    """
    bounded_batches(docs.sparkSession)
    sample = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.min(label).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_k"), "_k").limit(most))
    # the sample has at most ``most`` rows of two numbers
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(sample), "_k")
    one = texts.groupBy("_k").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y"))
    hashed = materialize(one.select("_k", "_y", row_udf(_make_features, "i binary, v binary", binary=True)("_t").alias("f")).select("_k", "_y", "f.i", "f.v"))
    # at most ``most`` rows of three numbers
    sizes = hashed.select("_k", (F.octet_length("i") + F.octet_length("v")).alias("_n"))
    held = F.sum("_n").over(Window.orderBy(F.xxhash64("_k"), "_k"))
    last = sizes.withColumn("_held", held).where(F.col("_held") <= most_bytes).select("_k", "_held").collect()
    if not last:
        return None
    taken = sizes.sparkSession.createDataFrame([(r[0],) for r in last], hashed.select("_k").schema)
    # fetched a few at a time, so that the driver's JVM never holds the sample
    parts = -(-last[-1]["_held"] // FETCH_BYTES) or 1
    fit_rows = hashed.join(F.broadcast(taken), "_k").select("_k", "_y", "i", "v").repartition(int(parts), "_k").toLocalIterator()
    rows = sorted(fit_rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1]))
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for _, y, i, v in rows])


def _make_rules(shared):
    model = shared.value if shared is not None else None

    def apply(text: bytes | None) -> tuple:
        words = text.split() if text else []
        return (*base_stats(text or b"", words), model.probability(model.margin(words)) if model else None)

    return apply


def judge(docs: DataFrame, model: Model | None, text: str = "text", out: str = "rules", keep: float = KEEP) -> DataFrame:
    """``docs`` with a struct ``out``: five counts, base_failed, p_good and kept.

    A text of fewer than 50 words, or more than half of it in repeated three-word windows, fails by
    the fixed rules; the others are kept where their calibrated probability of being good is at
    least ``keep``. Null and empty texts have no words and fail. Without a model only the fixed
    rules decide and p_good is null. A column named ``out`` is replaced; all rows and columns stay.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model) if model is not None else None
    found = docs.withColumn(out, row_udf(partial(_make_rules, shared), f"{STATS}, p_good double", binary=True)(F.col(text)))
    r = F.col(out)
    failed = (r["n_words"] < LEAST_WORDS) | (100 * r["n_repeat_words"] > MOST_REPEATED * r["n_words"])
    return found.withColumn(out, r.withField("base_failed", failed)
                            .withField("kept", ~failed & F.coalesce(r["p_good"] >= keep, F.lit(True))))
