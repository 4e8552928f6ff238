"""Substring deduplication with prefix-partitioned suffix trees.

A repeat is a run of ``window`` words or more that an earlier document holds
too.  In the suffix tree of all texts these are the internal nodes of depth
``window`` or more.  No task needs the whole tree:

1. One scan counts the suffixes under each prefix of 1, 2, 4 words (counts are
   kept per hash bucket, so their number is fixed).  ``prefix_groups`` gives a
   prefix that fits memory to a group as it is; a prefix with too many suffixes
   is replaced by its longer ones, in the end by whole windows.
2. A second scan sends every suffix to the group of its variable-length prefix.
   Of a batch of documents only the first one with a window sends it: the others
   already know an earlier owner, so a passage that a third of all documents
   share reaches a group once for each batch.
3. A group builds its subtree down to depth ``window``, as a sorted array of the
   names of the nodes at that depth (56 bits of a hash of the words on the path).  A node
   with leaves in two documents is a deep internal node; its first document is
   the owner of the words below it.
4. Nodes at neighbouring positions with the same owner join into maximal
   repeats.
5. Names are verified: both ends of every repeat are digested from their texts
   and compared.  After a mismatch (two paths of one name) the search runs again
   with other names.

Defined results: null and empty texts have no words; rows of one id are no earlier
documents to each other, and each loses what rows of smaller ids hold; rows with a null
id are kept whole; windows are judged on the input, not on what is left; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelog.llm.blobs import BLOBS, blob, blob_rows, columns_of, grouped
from tablelog.llm.common import drop_stored, has_bit, key_bit, key_bitmap, maybe_in, numbered, small_batches, stored, with_ids

WINDOW = 13
#: Prefix lengths in words; the last level is the window itself.
LEVELS = (1, 2, 4)
BUCKETS = 4096
#: Suffixes of one group (some 40 MB while it is sorted).
GROUP_SUFFIXES = 400_000
#: Documents whose repeats are found within a task, before anything is sent.
BATCH_ROWS = 256
#: Searches with other names at most; each needs a mismatch of the one before.
ROUNDS = 8


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words), dtype=np.uint64, count=len(words))


def path_names(hashes: np.ndarray, depth: int, window: int) -> np.ndarray:
    """Name of the first ``depth`` words of each suffix with ``window`` words or more."""
    n = max(0, len(hashes) - window + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(depth):
        out = out * np.uint64(0x5851F42D4C957F2D) + hashes[k : k + n]
    return _mixed(out)


def suffix_counts(docs: DataFrame, window: int, levels: tuple[int, ...]) -> np.ndarray:
    """Suffixes by level and hash bucket of their prefix; the last row counts windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(levels) + 1, BUCKETS), dtype=np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                h = word_hashes((text or "").encode().split(), 0)
                for k, depth in enumerate((*levels, window)):
                    name = path_names(h, depth, window)
                    total[k] += np.bincount((name % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        level, bucket = np.nonzero(total)
        arrays = [pa.array(level.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[level, bucket])]
        yield pa.RecordBatch.from_arrays(arrays, names=["level", "bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "level int, bucket int, n bigint")
    rows = rows.groupBy("level", "bucket").agg(F.sum("n").alias("n")).toPandas()  # fixed number of rows
    out = np.zeros((len(levels) + 1, BUCKETS), dtype=np.int64)
    out[rows["level"].to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def prefix_groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, number of groups) of each level and bucket, and the number of all groups.

    A bucket of too many suffixes has no group but at the last level, where it
    is split by the window's name.  Small buckets share a group.
    """
    first, parts, group, room = np.zeros_like(counts), np.zeros_like(counts), 0, most
    last = len(counts) - 1
    for level in range(last + 1):
        for bucket, n in enumerate(counts[level].tolist()):
            if n > most:
                if level == last:
                    own = -(-n // most)
                    first[level, bucket], parts[level, bucket] = group + 1, own
                    group, room = group + own, most
                continue
            # deeper levels hold only what shallower ones left; half is a guess that keeps groups full
            n = n >> (level > 0)
            if n > room:
                group, room = group + 1, most
            room -= n
            first[level, bucket], parts[level, bucket] = group, 1
    return first, parts, group + 1


def _groups_of(h: np.ndarray, window: int, levels: tuple[int, ...], first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    out = np.full(max(0, len(h) - window + 1), -1, dtype=np.int64)
    for k, depth in enumerate((*levels, window)):
        todo = np.flatnonzero(out < 0)
        if not len(todo):
            break
        name = path_names(h, depth, window)[todo]
        bucket = (name % np.uint64(BUCKETS)).astype(np.int64)
        own = parts[k, bucket]
        at = first[k, bucket] + ((name >> np.uint64(20)) % np.maximum(own, 1).astype(np.uint64)).astype(np.int64)
        out[todo] = np.where(own > 0, at, -1)
    return out


FOUND = (np.int64, np.int32, np.int64, np.int32)  # document, position, its owner's
#: Bytes of a name that are sent.
NAME_BYTES = 7


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number, byte by byte of all: what is alike stands together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def _suffix_blob(name: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Suffixes sorted by document and position: names as they are, the rest as runs and steps, compressed."""
    new = np.r_[True, doc[1:] != doc[:-1]]
    first = np.flatnonzero(new)
    step = np.where(new, pos, np.diff(pos, prepend=0))
    raw = doc[first].astype("<i8").tobytes() + np.diff(np.r_[first, len(doc)]).astype("<i8").tobytes() + _planes(step, 4)
    sizes = np.array([len(doc), len(first), len(raw)], dtype="<i8").tobytes()
    return sizes + _planes(name, NAME_BYTES) + pa.compress(raw, codec="zstd", asbytes=True)


def _suffixes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, document, position) of all blobs."""
    names, docs, places = [], [], []
    for x in blobs:
        n, n_docs, size = np.frombuffer(x, "<i8", 3).tolist()
        names.append(_unplaned(x, n, NAME_BYTES, 24))
        raw = pa.decompress(x[24 + n * NAME_BYTES :], size, codec="zstd", asbytes=True)
        count = np.frombuffer(raw, "<i8", n_docs, 8 * n_docs)
        docs.append(np.repeat(np.frombuffer(raw, "<i8", n_docs), count))
        total = np.cumsum(_unplaned(raw, n, 4, 16 * n_docs).astype(np.int64))
        first = np.r_[0, np.cumsum(count)[:-1]]
        before = np.r_[0, total][first]  # steps start anew in each document
        places.append((total - np.repeat(before, count)).astype(np.int32))
    return np.concatenate(names), np.concatenate(docs), np.concatenate(places)


def _owned(name: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices in order of name, document, position; for each the place of its name's first)."""
    order = np.lexsort((pos, doc, name))
    sorted_ = name[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def _found_rows(doc, pos, odoc, opos, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part by document, blob) of found nodes."""
    part = (_mixed(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((pos, doc, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = order[cuts[p] : cuts[p + 1]]
        if len(own):
            yield p, blob([doc[own], pos[own].astype(np.int32), odoc[own], opos[own].astype(np.int32)])


def repeats(
    docs: DataFrame, window: int = WINDOW, seed: int = 0, most: int = GROUP_SUFFIXES, levels: tuple[int, ...] = LEVELS
) -> DataFrame:
    """(doc, start, words, owner, owner_start): maximal repeats of (doc, text) rows, by name, not yet verified.

    ``doc`` is a long.  The owner is the smallest document that holds the words
    of each window of the repeat.
    """
    spark = docs.sparkSession
    counts = suffix_counts(docs, window, levels)
    first, group_parts, n_groups = prefix_groups(counts, most)
    tables = spark.sparkContext.broadcast((first, group_parts))
    parts = max(8, int(counts[-1].sum()) // (4 * most) * 4)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, group_parts = tables.value
        small = (x.slice(k, BATCH_ROWS) for x in batches for k in range(0, len(x), BATCH_ROWS))
        while some := list(islice(small, 2)):  # Arrow batches are half as many rows
            names, docs_, at, groups = [], [], [], []
            for b in some:
                for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                    h = word_hashes((text or "").encode().split(), seed)
                    if doc is None or len(h) < window:
                        continue
                    n = len(h) - window + 1
                    names.append(path_names(h, window, window))
                    docs_.append(np.full(n, doc, dtype=np.int64))
                    at.append(np.arange(n, dtype=np.int32))
                    h0 = h if not seed else word_hashes((text or "").encode().split(), 0)
                    groups.append(_groups_of(h0, window, levels, first, group_parts))
            if not names:
                continue
            name, doc, pos, group = map(np.concatenate, (names, docs_, at, groups))
            order, own = _owned(name, doc, pos)
            doc_, pos_ = doc[order], pos[order]
            later = doc_ != doc_[own]
            yield blob_rows(1, list(_found_rows(doc_[later], pos_[later], doc_[own][later], pos_[own][later], parts)))
            keep = order[~later]
            keep = keep[np.lexsort((pos[keep], doc[keep], group[keep]))]
            cuts = np.flatnonzero(np.r_[True, np.diff(group[keep]) > 0, True])
            rows = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                k = keep[i:j]
                rows.append((int(group[k[0]]), _suffix_blob(name[k], doc[k], pos[k])))
            yield blob_rows(0, rows)

    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, key), blobs in grouped(batches, True):
            if kind:
                yield blob_rows(1, [(key, blobs[0])])
                continue
            name, doc, pos = _suffixes(blobs)
            order, own = _owned(name, doc, pos)
            doc, pos = doc[order], pos[order]
            later = doc != doc[own]
            yield blob_rows(1, list(_found_rows(doc[later], pos[later], doc[own][later], pos[own][later], parts)))

    def maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(batches, False):
            doc, pos, odoc, opos = columns_of(blobs, FOUND)
            order = np.lexsort((opos, odoc, pos, doc))
            doc, pos, odoc, opos = doc[order], pos[order], odoc[order], opos[order]
            once = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]  # the smallest owner of each
            doc, pos, odoc, opos = doc[once], pos[once], odoc[once], opos[once]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (odoc[1:] != odoc[:-1]) | (np.diff(pos) != 1) | (np.diff(opos) != 1)]
            cuts = np.flatnonzero(new)
            words = np.diff(np.r_[cuts, len(doc)]) + window - 1
            for k in range(0, len(cuts), 50_000):
                c, w = cuts[k : k + 50_000], words[k : k + 50_000]
                arrays = [doc[c], pos[c], w.astype(np.int32), odoc[c], opos[c]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc", "start", "words", "owner", "owner_start"])

    small_batches(spark, BATCH_ROWS)
    sent = docs.select("doc", "text").mapInArrow(send, BLOBS)
    # a blob is some 100 kB: few to an Arrow batch
    found = sent.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(subtree, BLOBS)
    found = found.repartition("key").sortWithinPartitions("key")
    return found.mapInArrow(maximal, "doc bigint, start int, words int, owner bigint, owner_start int")


def _walk_documents(docs: DataFrame, asked: DataFrame, handle, schema: str) -> DataFrame:
    """Run ``handle(doc, words, requests)`` for each document with requests, streaming both.

    ``asked``: (doc, start, words, run).  Requests of a document follow its
    text in one sorted partition; they are an iterator, never gathered.
    """
    texts = docs.filter(maybe_in(asked, "doc")).select(
        "doc", F.lit(0).alias("kind"), "text", *[F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("words", "int"), ("run", "bigint"))]
    )
    rows = texts.union(asked.select("doc", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "start", "words", "run"))
    rows = rows.repartition("doc").sortWithinPartitions("doc", "kind", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from handle(
            row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc", "kind", "text", "start", "words", "run")))
        )

    return rows.mapInArrow(run, schema)


def mismatches(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run): repeats whose two ends are different words.  ``runs`` has a column ``run`` with distinct numbers."""
    ends = runs.select("doc", "start", "words", "run").union(runs.select("owner", "owner_start", "words", "run"))

    def handle(rows) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, bytes]] = []
        doc, words = None, []
        for d, kind, text, start, n, run in rows:
            if kind == 0:
                doc, words = d, (text or "").encode().split()
            elif d == doc:
                out.append((run, hashlib.md5(b" ".join(words[start : start + n])).digest()))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["run", "digest"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["run", "digest"])

    digests = _walk_documents(docs, ends, handle, "run bigint, digest binary")
    return digests.groupBy("run").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("run")


def verified_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, **options) -> DataFrame:
    """:func:`repeats` whose words were compared; see the module's text.

    A search without a mismatch is whole: a name of two paths shows as a
    mismatch wherever it gives a window the wrong owner.  Others are repeated with other names.
    """
    for seed in range(rounds):
        runs = repeats(docs, window, seed, **options).withColumn("run", F.monotonically_increasing_id())
        runs = stored(runs, "substring-runs")
        if mismatches(docs, runs).isEmpty():
            return runs.drop("run")
        drop_stored(runs)
    raise RuntimeError(f"{rounds} searches each met two paths of one name")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options
) -> DataFrame:
    """(id, n_words, n_removed, kept): ``kept`` is the words that no repeat covers, joined by one space.

    Ids are of any orderable type; rows with a null id are kept whole and own nothing.
    """
    source, same = numbered(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    docs = source.select("doc", "text")
    if same:
        runs = verified_repeats(docs, window, **options)
    else:  # rows are told apart; those of the least id own a window, and lose nothing by it
        runs = verified_repeats(source.filter("id IS NOT NULL").select("doc", "text"), window, **options)
        ids = source.select("doc", "id")
        runs = runs.join(ids, "doc").join(ids.select(F.col("doc").alias("owner"), F.col("id").alias("__of")), "owner")
        runs = stored(runs.filter("id <> __of"), "substring-owned")
    asked = runs.select("doc", "start", "words", F.lit(0).cast("long").alias("run"))
    schema = "doc bigint, n_words bigint, n_removed bigint, kept string"
    names = ["doc", "n_words", "n_removed", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def cut(doc, words: list[str], removed: np.ndarray) -> tuple:
        kept = [w for w, r in zip(words, removed.tolist()) if not r] if removed.any() else words
        return doc, len(words), len(words) - len(kept), " ".join(kept)

    def split(text) -> list[str]:
        return [w.decode() for w in (text or "").encode().split()]

    def handle(rows) -> Iterator[pa.RecordBatch]:
        out: list = []
        doc, words, removed = None, [], np.empty(0, dtype=bool)
        for d, kind, text, start, n, _ in rows:
            if kind == 0:
                if doc is not None:
                    out.append(cut(doc, words, removed))
                doc, words = d, split(text)
                removed = np.zeros(len(words), dtype=bool)
            else:
                removed[start : start + n] = True
            if len(out) >= 200:
                yield batch(out)
                out = []
        if doc is not None:
            out.append(cut(doc, words, removed))
        if out:
            yield batch(out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~has_bit(touched.value, b.column("bit").to_numpy())))
            words = [(d, split(t)) for d, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist())]
            if words:
                yield batch([(d, len(w), 0, " ".join(w)) for d, w in words])

    small_batches(df.sparkSession)
    touched = key_bitmap(asked, "doc")
    untouched = docs.withColumn("bit", key_bit("doc")).mapInArrow(whole, schema)
    out = _walk_documents(docs, asked, handle, schema).union(untouched)
    return with_ids(out, source, same, "id").withColumnRenamed("id", id_col).select(id_col, "n_words", "n_removed", "kept")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), r AS (
  SELECT doc_id, i FROM p QUALIFY doc_id > min(doc_id) OVER (PARTITION BY v)
), x AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r
), a AS (
  SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM a ANTI JOIN x USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
