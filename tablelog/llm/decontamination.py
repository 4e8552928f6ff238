"""Benchmark decontamination with a distributed positional inverted index.

The test items are taken in blocks of bounded size.  For each block:

1. one scan counts how often its terms occur in the training texts;
2. of every window of the items the rarest terms become its anchors (a window
   and its neighbours mostly share them), and a second scan stores the postings
   (term, document, position) of the anchors: the index;
3. offset-adjusted posting lists are intersected: a posting at p of a term at q
   in an item lies on diagonal p - q, and a window can only occur on a diagonal
   that holds all of its anchors;
4. the documents on surviving diagonals are compared word by word there, which
   gives the exact phrases; ``proximity_matches`` returns the near misses.

What is sent to all executors is one block of items and its anchors (at most
``BLOCK_WORDS`` words, unless one item alone is longer) and a bitmap of fixed
size; links of documents stay distributed.

Defined results: null and word-free texts have no words and no hits; items of
fewer words than a window are one window; repeated items each count under
their item_id; rows whose ids repeat or are null are judged each by its own text;
empty tables give no items or no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelog.llm.common import maybe_in, numbered, small_batches, stored, with_ids

WINDOW = 13
#: Terms of each window that the intersection asks for.
ANCHORS = 3
BLOCK_WORDS = 500_000
#: Words: not ASCII except digits and letters.  Over bytes, all bytes of other characters belong to words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the windows of an item."""
    if not words:
        return []
    if len(words) < window:
        return [(0, len(words))]
    return [(s, window) for s in range(len(words) - window + 1)]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words (one item at least), streamed to the driver."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        w = words_of(r["t"])
        if not w:
            continue
        if block and size + len(w) > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], w))
        size += len(w)
    if block:
        yield block


def term_counts(docs: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Occurrences of each term in all texts; counts combine before the shuffle."""
    spark = docs.sparkSession
    number = spark.sparkContext.broadcast({t: n for n, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                total.update(filter(number.value.__contains__, words_of(text)))
        if total:
            term = [number.value[t] for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r["term"]]: r["n"] for r in rows}


def anchors_of(words: list[bytes], freq: dict[bytes, int], window: int = WINDOW, anchors: int = ANCHORS) -> dict[tuple[int, int], list[int]]:
    """Window -> its rarest positions.  A window with a term that no text has can't occur and is left out."""
    rank = [(freq.get(w, 0), hashlib.md5(w).digest(), q) for q, w in enumerate(words)]
    out = {}
    for s, n in windows_of(words, window):
        own = sorted(rank[s : s + n])
        if own[0][0]:
            out[s, n] = sorted(q for _, _, q in own[:anchors])
    return out


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """The positional index: (term, doc, pos) for the given terms; and for each text (-1, doc, number of words)."""
    number = docs.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        for b in batches:
            row, term, pos = [], [], []
            for n, text in enumerate(b.column("text").to_pylist()):
                w = words_of(text)
                row.append(n)
                term.append(-1)
                pos.append(len(w))
                for p, x in enumerate(w):
                    if x in of:
                        row.append(n)
                        term.append(of[x])
                        pos.append(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(term, pa.int32()), b.column("doc").take(pa.array(row, pa.int64())), pa.array(pos, pa.int32())],
                names=["term", "doc", "pos"],
            )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"term int, doc {kind}, pos int")


def _spans(words: list[bytes], items: dict, cands: list, window: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Disjoint spans of hit words of one text, and the items that hit, from its (item, diagonal) candidates."""
    runs, found = [], set()
    for item, diagonal in cands:
        own = items[item]
        need, run = min(window, len(own)), 0
        last = min(len(own), len(words) - diagonal)
        for q in range(max(0, -diagonal), last + 1):
            if q < last and own[q] == words[q + diagonal]:
                run += 1
                continue
            if run >= need:
                runs.append((q + diagonal - run, q + diagonal))
                found.add(item)
            run = 0
    merged: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, found


def _probes(block: list, freq: dict[bytes, int], window: int, anchors: int) -> tuple[dict[bytes, int], list, list]:
    """Number of each anchor term, (term, item, position) rows, and the anchor sets that each item asks for."""
    number: dict[bytes, int] = {}
    rows, asked = [], []
    for item, (_, words) in enumerate(block):
        used = anchors_of(words, freq, window, anchors)
        rows += [(number.setdefault(words[q], len(number)), item, q) for q in sorted({q for qs in used.values() for q in qs})]
        asked.append([frozenset(a) for a in dict.fromkeys(map(tuple, used.values()))])
    return number, rows, asked


def _block_hits(docs: DataFrame, block: list, window: int, anchors: int) -> tuple[DataFrame, DataFrame]:
    """((doc, n_words), (doc, spans, items)) of one block of items."""
    spark = docs.sparkSession
    freq = term_counts(docs, sorted({w for _, words in block for w in words}))
    number, rows, asked = _probes(block, freq, window, anchors)
    index = stored(postings(docs, list(number)), "decontamination-index")
    n_words = index.filter("term = -1").select("doc", F.col("pos").cast("long").alias("n_words"))
    # the probes are the anchors of one block, bounded by its words
    probe = spark.createDataFrame(rows or [(-2, 0, 0)], "term int, item int, q int")
    lists = index.filter("term >= 0").join(F.broadcast(probe), "term")
    lists = lists.groupBy("doc", "item", (F.col("pos") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"))
    wanted = spark.sparkContext.broadcast(asked)

    @F.pandas_udf("boolean")
    def holds(item: pd.Series, qs: pd.Series) -> pd.Series:
        """Whether some window has all of its anchors on the diagonal."""
        return pd.Series([any(a <= s for a in wanted.value[i]) for i, s in zip(item, map(set, qs))], dtype=bool)

    cands = stored(lists.filter(holds("item", "qs")).select("doc", "item", "diagonal"), "decontamination-diagonals")
    of_doc = cands.groupBy("doc").agg(F.collect_list(F.struct("item", "diagonal")).alias("cands"))
    texts = docs.filter(maybe_in(cands, "doc")).join(of_doc, "doc").select("doc", "text", "cands")
    items = spark.sparkContext.broadcast([(str(i), w) for i, w in block])
    kind = docs.schema["doc"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(enumerate(w for _, w in items.value))
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for b in batches:
            spans, ids = [], []
            for text, cands in zip(b.column("text").to_pylist(), b.column("cands").to_pylist()):
                merged, found = _spans(words_of(text), own, [(c["item"], c["diagonal"]) for c in cands], window)
                spans.append([{"from": x, "to": y} for x, y in merged])
                ids.append([items.value[n][0] for n in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(spans, span), pa.array(ids, pa.list_(pa.string()))], names=["doc", "spans", "items"]
            )

    hits = texts.mapInArrow(verify, f"doc {kind}, spans array<struct<from:int,to:int>>, items array<string>")
    return n_words, hits.filter(F.size("items") > 0)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    anchors: int = ANCHORS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for each row of ``docs``.

    ``spans`` are lists of hit spans in words (per block of items), ``items``
    the sorted ids, as strings, of the items with an occurring window.
    """
    small_batches(docs.sparkSession)
    source, same = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    docs = source.select("doc", "text")
    n_words, hits = None, None
    for block in _blocks(items, item_col, "text", block_words):
        n, h = _block_hits(docs, block, window, anchors)
        n_words, hits = n_words or n, h if hits is None else hits.union(h)
    if hits is None:
        n_words = with_ids(postings(docs, []).select("doc", F.col("pos").cast("long").alias("n_words")), source, same, "id")
        none = F.array().cast("array<struct<from:int,to:int>>"), F.array().cast("array<string>")
        return n_words.select(
            F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), none[0].alias("spans"), none[1].alias("items")
        )
    hits = hits.groupBy("doc").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))
    covered = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"], acc["last"]))).alias("n"),
            F.greatest(acc["last"], s["to"]).alias("last"),
        ),
        lambda acc: acc["n"],
    )
    out = with_ids(n_words.join(hits.withColumn("n_hit", covered), "doc", "left"), source, same, "id")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def proximity_matches(
    docs: DataFrame, queries: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(id, item id, start): texts that hold all words of a query, each at most ``slop`` words off its place.

    ``start`` is where the query would begin by the posting of its rarest term.
    The same index and intersection as for phrases, with diagonals that may
    differ by ``slop``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(queries, item_col, "text", BLOCK_WORDS):
        freq = term_counts(docs, sorted({w for _, words in block for w in words}))
        number: dict[bytes, int] = {}
        rows = []
        for item, words in block:
            if any(w not in freq for w in words):
                continue
            rarest = min(range(len(words)), key=lambda q: (freq[words[q]], q))
            rows += [(number.setdefault(w, len(number)), str(item), q, len(words), q == rarest) for q, w in enumerate(words)]
        if not rows:
            continue
        index = stored(postings(docs, list(number)), "proximity-index").filter("term >= 0")
        probe = spark.createDataFrame(rows, "term int, item string, q int, terms int, rarest boolean")
        lists = index.join(F.broadcast(probe), "term").withColumn("diagonal", F.col("pos") - F.col("q"))
        near = F.floor(F.col("diagonal") / (slop + 1))
        first = lists.filter("rarest").select("doc", "item", F.col("diagonal").alias("start"), F.explode(F.array(near - 1, near, near + 1)).alias("near"))
        met = lists.withColumn("near", near).join(first, ["doc", "item", "near"])
        met = met.filter(F.abs(F.col("diagonal") - F.col("start")) <= slop).groupBy("doc", "item", "start", "terms")
        met = met.agg(F.countDistinct("q").alias("n")).filter("n = terms").select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "start")
        out = met if out is None else out.union(met)
    kind = docs.schema["doc"].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"{id_col} {kind}, {item_col} string, start int")


def contaminated():
    """A text is contaminated if at least a twentieth of its words are hit."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = find_contamination(docs, items)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), k AS (
  SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0
), v AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)
), h AS (
  SELECT doc_id, i, n, item_id FROM p JOIN v USING (n, v)
), c AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
"""
