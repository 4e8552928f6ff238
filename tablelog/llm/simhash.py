"""SimHash near-duplicates with pivot distance tables.

A fingerprint is located by its Hamming distances to many reference
fingerprints.  Two fingerprints within ``radius`` bits differ by at most
``radius`` in every such coordinate, so a larger difference in any one discards
the pair; survivors are verified bit by bit.

The first references are a base and its 64 neighbours (the base with bit j
inverted).  A neighbour is nearer to a fingerprint than the base by one, or farther by
one, so the differences of these 65 distances are 64 coordinates of 1 or -1, of
which two fingerprints differ in as many as in bits.  They are dealt into groups:
``radius`` differences touch at most ``radius`` groups, so a pair agrees in the
coordinates of all the others, which are the join key (every choice of untouched
groups is one).  Within a key the distances to pseudo-random references discard pairs
by their largest difference.

Equal fingerprints collapse before any pair is formed.  A key with more than
``BUCKET`` fingerprints is not compared pairwise: its members are linked
exactly through their one-bit neighbours (two words are within two bits if and
only if some word is within one bit of both).

``first_links`` is the same search with a wider radius and one partner for each
fingerprint: candidates for a check of another kind (``near_documents``).

Defined results: a null, empty or blank text has fingerprint 0 and is linked
like any other; repeated doc_ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelog.llm.common import small_batches, stored
from tablelog.llm.components import connected_components

SEED = 42
#: Pseudo-random references of the table.
REFERENCES = 24
#: Most fingerprints of one key that are compared pairwise.
BUCKET = 2048
#: Edges held before they are reduced to labels.
EDGES = 500_000
#: Radius of :func:`first_links`.
WIDE = 6


def references(n: int, seed: int = 1) -> np.ndarray:
    """n fixed 64-bit words by the SplitMix64 rule."""
    out, mask = [], (1 << 64) - 1
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def distance_table(fingerprints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint (row) to each reference (column)."""
    return np.bitwise_count(fingerprints[:, None] ^ pivots[None, :])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, unsigned; see the module's text."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII space splits
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(b" ".join(s), SEED) for s in zip(*(w[k:] for k in range(shingle)))], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 4096 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit form of the fingerprint of each row."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp bigint")
    return out.withColumnRenamed("id", id_col)


def neighbours(base: np.uint64) -> np.ndarray:
    """A reference and the 64 that differ from it in one bit."""
    return np.r_[base, base ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]


def coordinates(fingerprints: np.ndarray, base: np.uint64) -> np.ndarray:
    """Distance to each neighbour of a reference less that to the reference itself: 1 or -1, by row and neighbour."""
    table = distance_table(fingerprints, neighbours(base)).astype(np.int8)
    return table[:, 1:] - table[:, :1]


def key_groups(radius: int, groups: int) -> list[np.ndarray]:
    """Places of the coordinates in each choice of ``groups - radius`` of the groups."""
    one = np.array_split(np.arange(64), groups)
    return [np.concatenate([one[g] for g in chosen]) for chosen in combinations(range(groups), groups - radius)]


def keyed(distinct: DataFrame, chosen: list[np.ndarray]) -> DataFrame:
    """(k, fp): each fingerprint with the key of each choice of coordinates."""
    base = references(1, seed=99)[0]
    weight = references(64 * len(chosen), seed=7).reshape(len(chosen), 64) | np.uint64(1)
    masks = np.zeros((len(chosen), 64), dtype=bool)
    for n, places in enumerate(chosen):
        masks[n, places] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            up = coordinates(fp, base) > 0
            keys = []
            for n in range(len(chosen)):  # a key packs its coordinates; its number keeps keys of other choices apart
                bits = np.packbits(up[:, masks[n]], axis=1, bitorder="little")
                packed = np.zeros((len(fp), 8), np.uint8)
                packed[:, : bits.shape[1]] = bits
                z = (packed.view("<u8").ravel() ^ weight[n, 0]) * weight[n, 1]
                keys.append((z ^ (z >> np.uint64(29))) * weight[n, 2])
            k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.tile(fp, len(chosen)).view(np.int64))], names=["k", "fp"])

    return distinct.select("fp").mapInArrow(run, "k bigint, fp bigint")


def _labels(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the edges, from the labels so far."""
    while len(i):
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(old, label):
            break
    return label


def linked_in_keys(key: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) among fingerprints with equal keys; ``key`` is sorted."""
    n = len(fp)
    table = distance_table(fp, pivots).astype(np.int8)
    label = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    i, step, size = np.arange(n), 0, 0
    while True:
        step += 1
        i = i[i + step < n]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        j = i + step
        near = label[i] != label[j]
        a, b = i[near], j[near]
        for p in range(len(pivots)):  # maximum coordinate difference, one reference at a time
            close = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[close], b[close]
            if not len(a):
                break
        close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        held.append((a[close], b[close]))
        size += int(close.sum())
        if size > EDGES:
            label = _labels(n, *(np.concatenate(x) for x in zip(*held)), label)
            held, size = [], 0
    if held:
        label = _labels(n, *(np.concatenate(x) for x in zip(*held)), label)
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def least_in_keys(key: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member within ``radius`` that stands before it) among fingerprints with equal keys; ``key`` is sorted."""
    n = len(fp)
    table = distance_table(fp, pivots).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    i = np.repeat(starts, np.diff(np.r_[starts, n]))
    j, first = np.arange(n), np.full(n, -1)
    while True:
        before = i < j
        i, j = i[before], j[before]
        if not len(j):
            break
        a, b = i, j
        for p in range(len(pivots)):  # as in linked_in_keys
            close = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[close], b[close]
            if not len(a):
                break
        close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        first[b[close]] = a[close]
        left = first[j] < 0
        i, j = i[left] + 1, j[left]
    found = np.flatnonzero(first >= 0)
    return fp[found], fp[first[found]]


def _walk(batches: Iterator[pa.RecordBatch], radius: int, bucket: int, linked=linked_in_keys) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by k: complete keys are compared, too large ones passed on with ``large``."""
    pivots = references(REFERENCES)
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    skip: tuple | None = None  # key that turned out too large: its members go straight on

    def out(a, b, large):
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), large))],
            names=["a", "b", "large"],
        )

    def compared(k, f):
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        many = np.repeat(sizes > bucket, sizes)
        some = np.repeat(sizes > 1, sizes) & ~many
        if many.any():
            yield out(f[many], f[many], True)
        if some.any():
            yield out(*linked(k[some], f[some], radius, pivots), False)

    for b in batches:
        k, f = b.column("k").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
        if skip:
            passed = k == skip[0]
            if passed.any():
                yield out(f[passed], f[passed], True)
            k, f = k[~passed], f[~passed]
            if not len(k):
                continue
            skip = None
        key, fp = np.r_[key, k], np.r_[fp, f]
        last = np.searchsorted(key, key[-1])
        yield from compared(key[:last], fp[:last]) if last else ()
        key, fp = key[last:], fp[last:]
        if len(key) > bucket:
            skip = (key[0],)
            yield out(fp, fp, True)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from compared(key, fp)


def _neighbour_edges(members: DataFrame, radius: int) -> DataFrame:
    """Edges among crowded fingerprints (column ``a``), by the words within one bit of each."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in range(64)])
    near = members.select("a", F.explode(F.transform(flips, lambda x: F.col("a").bitwiseXOR(x))).alias("mid"))
    if radius == 1:
        return near.filter("mid <> a").join(members.select(F.col("a").alias("mid")), "mid").select("a", F.col("mid").alias("b"))
    stars = near.groupBy("mid").agg(F.min("a").alias("b"), F.max("a").alias("c")).filter("b <> c")
    return near.join(stars.select("mid", "b"), "mid").filter("a <> b").select("a", "b")


def links(distinct: DataFrame, radius: int = 2, groups: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly what links within ``radius`` (1 or 2) connect.

    ``distinct`` has one row for each fingerprint, column ``fp``.  Rows per
    fingerprint are fixed by ``groups``; none holds a group of another key.
    """
    if radius not in (1, 2):
        raise ValueError(f"radius {radius}: crowded keys are linked exactly up to 2")
    if groups is None:  # longer keys, and more of them, once 32 coordinates would be crowded
        groups = radius + (2 if distinct.count() < 1 << 28 else 4)
    return _found(distinct, radius, groups, bucket, linked_in_keys).distinct()


def _found(distinct: DataFrame, radius: int, groups: int, bucket: int, linked) -> DataFrame:
    """(a, b): what ``linked`` finds within keys, and the links within 2 bits of members of crowded keys."""
    spark = distinct.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    rows = keyed(distinct, key_groups(radius, groups)).repartition("k").sortWithinPartitions("k", "fp")
    found = stored(
        rows.mapInArrow(lambda batches: _walk(batches, radius, bucket, linked), "a bigint, b bigint, large boolean"), "simhash-links"
    )
    small_batches(spark)
    large = found.filter("large").select("a").distinct()
    return found.filter("not large").select("a", "b").union(_neighbour_edges(large, min(radius, 2)))


def first_links(distinct: DataFrame, radius: int = WIDE, groups: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b as signed numbers: for each fingerprint ``b`` the least one within ``radius``, if there is one.

    One row for each ``b``, however large its group.  Where a key has more than ``bucket``
    members its links are looked for within 2 bits only: the caller has to find the rest.
    """
    if groups is None:  # as in links, for 16 coordinates
        groups = radius + (2 if distinct.count() < 1 << 24 else 3)
    found = _found(distinct, radius, groups, bucket, least_in_keys)
    return found.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id that links reach, itself included."""
    prints = stored(fingerprints(df, id_col, text_col, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = connected_components(links(distinct.select("fp"), radius))
    owner = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = owner.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = owner.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
