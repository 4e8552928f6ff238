"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled 1; every document is unlabelled web
text; no negative label is used.  The non-negative unbiased risk (Kiryo et al.,
2017) of a linear score g with squared loss, for a class prior p, is

    p E_pos[(1 - g)^2]/4 + max(0, E_unl[(1 + g)^2]/4 - p E_pos[(1 + g)^2]/4).

With a ridge it is the larger of two convex quadratic forms, so ``fit`` finds its
minimum exactly.  It depends on the data through the first and second moments of
the features only: all rows count, and the driver holds two small matrices.
Positives may be bounded by ``max_labelled`` (none by default).

The prior is estimated from positives and unlabelled text: for any set S of texts
P_unl(S) / P_pos(S) is the prior or more, and equal where S holds no
negatives (Blanchard et al., 2010).  The sets tried are the upper ends of a
score that tells positives from unlabelled text, fitted on the other half of the
rows, and hold at least half of the positives.

Only rows of the training folds, crc32(id as text) mod 3 other than 1, give
labels, moments or the prior.

Defined results: null and empty texts have the features of no words and a score;
without any positive every score is 0.5; several labels of an id count each; rows
that repeat are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelog.llm.common import small_batches, stored

FOLDS, HELD_OUT = 3, 1
#: Least ridge; 2 / rows where that is more.
RIDGE = 1e-4
#: Buckets of hashed words, and the weight of their features beside the shares.
WORD_BUCKETS, WORD_WEIGHT = 64, 0.5
#: Bins of the score's histogram for the prior, over -4 to 4.
BINS = 2000
#: Steps of every share: x, its root, and where it exceeds these.
STEPS = (0.01, 0.03, 0.1, 0.3)
#: Byte classes that are counted.
_LOWER, _UPPER, _DIGIT = range(97, 123), range(65, 91), range(48, 58)
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]


def shares(data: bytes, w: list[bytes], seen: Counter) -> np.ndarray:
    """Shares from 0 to 1 that describe the form of a whole text."""
    n = max(1, len(w))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = max(1, len(data) - int(count[9:14].sum()) - int(count[32]))
    lower, upper, other = (int(count[list(x)].sum()) for x in (_LOWER, _UPPER, _OTHER))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    windows = Counter(zip(w, w[1:], w[2:], w[3:]))
    return np.array(
        [
            upper / max(1, upper + lower),
            other / solid,
            int(count[list(_DIGIT)].sum()) / solid,
            int(count[124]) / n,
            data.count(b"!!") / n,
            sum(x.isupper() for x in w) / n,
            sum(not x.isalnum() and not x[:-1].isalnum() and x.isascii() for x in w) / n,
            sum(map(eq, w, w[1:])) / n,
            1 - len(seen) / n,
            max(seen.values(), default=0) / n,
            sum(c for c in windows.values() if c > 1) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            float((lengths > 20).sum()) / n,
            float((lengths < 2).sum()) / n,
            min(1.0, float(lengths.sum()) / n / 20),
            1.0 / (1 + len(w)),
            min(1.0, len(lines) / n),
            sum(int(count[b]) for b in b".,;?") / n,
        ]
    )


def content(seen: Counter) -> np.ndarray:
    """What a text says: its words in hash buckets, as a vector of length ``WORD_WEIGHT`` (0 without words)."""
    h = np.fromiter((xxhash.xxh64_intdigest(x) for x in seen), np.uint64, len(seen))
    weight = np.log1p(np.fromiter(seen.values(), np.float64, len(seen)))
    sign = np.where(h >> np.uint64(63), weight, -weight)
    out = np.bincount((h % np.uint64(WORD_BUCKETS)).astype(np.int64), weights=sign, minlength=WORD_BUCKETS)
    return WORD_WEIGHT * out / max(1e-9, float(np.linalg.norm(out)))


def features(text: str | None) -> np.ndarray:
    """1, each share, its root and its steps, and the hashed words."""
    data = (text or "").encode()
    w = data.split()
    seen = Counter(w)
    x = np.clip(shares(data, w, seen), 0, 1)
    words = content(Counter(x.strip(b".,;:!?()\"'").lower() for x in w) if w else seen)
    return np.concatenate([[1.0], x, np.sqrt(x), *[(x > s).astype(float) for s in STEPS], words]).astype(np.float32)


SIZE = len(features(""))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, SIZE).astype(np.float64)


def _halves(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    x, half = _matrix(b), b.column("half").to_numpy()
    yield from ((k, x[half == k]) for k in (0, 1))


def _moments(rows: DataFrame) -> list[tuple[float, np.ndarray]]:
    """For each half (rows, mean outer product of the features); the first row of that is the mean.

    A task sends the upper triangles of its two sums, which combine before the shuffle.
    """
    upper = np.triu_indices(SIZE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(2), np.zeros((2, SIZE, SIZE))
        for b in batches:
            for k, x in _halves(b):
                total[k] += x.T @ x
                n[k] += len(x)
        for k in np.flatnonzero(n):
            own = np.r_[total[k][upper], n[k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)) + k * len(own)), pa.array(own)], names=["k", "v"])

    out = rows.select("x", "half").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(2 * (len(upper[0]) + 1))
    sums[out["k"].to_numpy(np.int64)] = out["v"].to_numpy()
    found = []
    for own in np.split(sums, 2):
        m = np.zeros((SIZE, SIZE))
        m[upper] = own[:-1]
        found.append((own[-1], (m + np.triu(m, 1).T) / max(1.0, own[-1])))
    return found


def _together(a: tuple[float, np.ndarray], b: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
    n = a[0] + b[0]
    return n, (a[0] * a[1] + b[0] * b[1]) / max(1.0, n)


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float) -> tuple[float, float]:
    """(non-negative risk with ridge, its part of the negatives before it is cut at 0), from the moment matrices."""
    quad = lambda m, sign: (1 + 2 * sign * m[0] @ w + w @ m @ w) / 4
    negative = quad(unlabelled, 1) - prior * quad(positive, 1)
    return prior * quad(positive, -1) + max(0.0, negative) + ridge * w @ w / 4, negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the non-negative risk, from the two moment matrices.

    The risk is max(A, B): A counts the negatives' part as it is, B as 0.  Both are
    convex, so the minimum of some A + (1 - share) B, share from 0 to 1, is that of
    max(A, B).  The negatives' part falls as the share grows; at its zero, or at the
    end it doesn't cross, lies the minimum.
    """
    eye = ridge * np.eye(len(positive))

    def at(share: float) -> np.ndarray:
        inner = share * unlabelled + (1 - share) * prior * positive + eye
        return np.linalg.solve(inner, (1 + share) * prior * positive[0] - share * unlabelled[0])

    part = lambda w: risk(w, positive, unlabelled, prior, ridge)[1]
    if part(at(1.0)) >= 0:
        return at(1.0)
    if part(at(0.0)) <= 0:
        return at(0.0)
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if part(at(middle)) > 0 else (low, middle)
    return min(at(low), at(high), key=lambda w: risk(w, positive, unlabelled, prior, ridge)[0])


def telling(positive: np.ndarray, unlabelled: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the least-squares score that is 1 for positives and -1 for unlabelled text."""
    return np.linalg.solve(positive + unlabelled + ridge * np.eye(len(positive)), positive[0] - unlabelled[0])


def _binned(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(((x @ weights + 4) * BINS / 8).astype(np.int64), 0, BINS - 1)


def _histogram(rows: DataFrame, weights: list[np.ndarray]) -> np.ndarray:
    """Rows by the bin of their score; each half has weights of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for k, x in _halves(b):
                total += np.bincount(_binned(x, weights[k]), minlength=BINS)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    out = rows.select("x", "half").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BINS, np.int64)
    total[out["k"].to_numpy(np.int64)] = out["n"].to_numpy(np.int64)
    return total


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least share of unlabelled over positive texts in upper ends of the score, from the two histograms."""
    p, u = (np.cumsum(x[::-1]) / max(1, x.sum()) for x in (positive, unlabelled))
    enough = p >= 0.5
    return float(np.clip((u[enough] / p[enough]).min(), 0.001, 0.999)) if enough.any() else 0.5


def score_documents(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int | None = None
) -> DataFrame:
    """(id, held_out, score) for each row; see the module's text."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x, pa.list_(pa.float32()))], names=["id", "x"])

    kind = source.schema["id"].dataType.simpleString()
    rows = stored(source.mapInArrow(run, f"id {kind}, x array<float>").withColumn("held_out", held_out(F.col("id"))), "quality-features")
    ones = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter((F.col("y") == 1) & ~held_out(F.col("id"))).select("id")
    if max_labelled is not None:
        ones = ones.orderBy(F.xxhash64("id")).limit(max_labelled)
    half = F.xxhash64("id").bitwiseAND(F.lit(1))
    trusted = stored(rows.join(ones, "id").select("x", half.alias("half")), "quality-positives")
    training = rows.filter("not held_out").select("x", half.alias("half"))
    halves = [_moments(part) for part in (trusted, training)]
    (n_pos, positive), (n_all, unlabelled) = (_together(*m) for m in halves)
    ridge = max(RIDGE, 2 / max(1.0, n_all))
    weights = np.zeros(SIZE)
    if n_pos:
        # rows of one half are told apart by what the other half tells
        tells = [telling(halves[0][1 - k][1], halves[1][1 - k][1], ridge) for k in (0, 1)]
        weights = fit(positive, unlabelled, prior_of(_histogram(trusted, tells), _histogram(training, tells)), ridge)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(np.clip((_matrix(b) @ weights + 1) / 2, 0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), score], names=["id", "held_out", "score"])

    out = rows.mapInArrow(scored, f"id {kind}, held_out boolean, score double")
    return out.withColumnRenamed("id", id_col)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, labels)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
