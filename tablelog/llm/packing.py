"""Best-fit packing of documents into sequences by bin completion.

Documents become token ids with an end id behind each.  Those longer than a
sequence are cut from their end into full pieces, so only the first piece may be
shorter.  What matters for packing is how many pieces there are of each length:
a histogram of at most ``capacity`` entries, whatever the size of the corpus.

``complete_bins`` packs the histogram by branch and bound.  Around the largest
piece left it enumerates the fillings of the rest of the bin that no other
filling dominates, least waste first, follows each, and turns back where the
waste leaves no better packing than the incumbent; the first incumbent is
best-fit decreasing, and a lower bound of the bins ends the search.

Each piece is then ranked among the pieces of its length and reads its place
off the (length, rank) ranges that the fillings give out.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelog.llm.common import small_batches, stored

CAPACITY = 1024
END_ID = 2
#: Search nodes of a packing; the best packing so far is taken when they are used up.
NODES = 200_000
#: Pieces up to which bins are branched on one by one, and ways tried at a node of more.
SINGLE, BRANCHES = 400, 4
#: Pieces of one length are ranked in parts of about this many, in so many parts at most.
PART_ROWS, PARTS = 10_000, 4096


# -- tokens ------------------------------------------------------------------


@cache
def _encoder(tokenizer: str):
    """Function from text to ids for a ``tokenizers`` file.

    A byte-level BPE file with a ``.tiktoken`` file of the same vocabulary beside
    it is encoded from that, which gives the same ids several times faster; what
    it refuses, and texts that hold the string of an added token (one id, as the
    ``tokenizers`` library gives by default), go to that library.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    slow.no_truncation()

    def by_tokenizers(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    fast = _same_vocabulary(tokenizer)
    if fast is None:
        return by_tokenizers

    added = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return by_tokenizers(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # noqa: BLE001 - its native panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return by_tokenizers(text)

    return encode


def _same_vocabulary(tokenizer: str):
    try:
        import public_tokenizers
        import tiktoken

        with open(tokenizer.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, FileNotFoundError):
        return None
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, length, capacity)]


def tokenized_pieces(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): one row for each piece; ids is null without ``keep_ids``."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for b in batches:
            rows: list = []
            for n, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((n, piece, start, length, zlib.crc32(own), own.tolist() if keep_ids else None))
            if rows:
                n, *columns = zip(*rows)
                arrays = [b.column("id").take(pa.array(n)), *(pa.array(c, t) for c, t in zip(columns, types))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>")
    return out.withColumnRenamed("id", id_col)


# -- the histogram -----------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: [(lengths of a bin, number of such bins)]."""
    done: list[tuple[tuple[int, ...], int]] = []
    bins: Counter = Counter()  # (space left, content) -> bins
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            fits = [k for k in bins if k[0] >= length]
            if not fits:
                new = capacity // length
                full = todo // new
                if full:
                    bins[(capacity - new * length, (length,) * new)] += full
                if rest := todo - full * new:
                    bins[(capacity - rest * length, (length,) * rest)] += 1
                break
            space, content = k = min(fits)
            used = min(bins[k], todo)
            bins[k] -= used
            if not bins[k]:
                del bins[k]
            after = (space - length, content + (length,))
            if after[0]:
                bins[after] += used
            else:
                done.append((after[1], used))
            todo -= used
    return done + [(content, n) for (_, content), n in bins.items()]


def _bits(lengths) -> int:
    return sum(1 << n for n in lengths)


def _smeared(bits: int, steps: int) -> int:
    """``bits`` and their shifts by 1 to ``steps``."""
    done = 0
    while done < steps:
        by = min(done + 1, steps - done)
        bits |= bits << by
        done += by
    return bits


def dominated(filling: tuple[int, ...], spare: int, others: int) -> bool:
    """Whether one of ``others`` (bits of lengths not in the bin) can take the place of some of ``filling``.

    A piece x that is as long as some pieces together, or longer by no more than
    the space they leave, does no worse in their place: what it frees fits
    wherever x stood (Martello and Toth's dominance for one piece).  No piece in
    place of none means that the filling isn't full.
    """
    if others & ((1 << (spare + 1)) - 1):
        return True
    one = more = 0  # sums of one piece, of two or more
    for n in filling:
        more |= (more | one) << n
        one |= 1 << n
    if _smeared(more, spare) & others:
        return True
    return bool(spare and _smeared(one << 1, spare - 1) & others)


class _Search:
    """Depth-first bin completion of a histogram; see :func:`complete_bins`."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.capacity, self.budget = capacity, nodes

    def fillings(self, first: int, most: int) -> Iterator[tuple[int, ...]]:
        """Undominated fillings around ``first`` that waste at most ``most``, in bands of growing waste."""
        left, space = self.left, self.capacity - first
        lengths = sorted((n for n in left if n <= space), reverse=True)
        usable = [min(left[n], space // n) for n in lengths]
        rest = [0] * (len(lengths) + 1)
        for k in range(len(lengths) - 1, -1, -1):
            rest[k] = rest[k + 1] + lengths[k] * usable[k]
        all_bits = _bits(lengths)

        def extend(at: int, room: int, chosen: tuple[int, ...], others: int, least: int, most: int):
            if least <= room <= most and not dominated(chosen, room, others):
                yield (first, *chosen)
            for k in range(at, len(lengths)):
                if self.budget <= 0 or room - rest[k] > most:
                    return
                n = lengths[k]
                for times in range(min(usable[k], room // n), 0, -1):
                    self.budget -= 1
                    now = others & ~(1 << n) if times == left[n] else others
                    yield from extend(k + 1, room - times * n, chosen + (n,) * times, now, least, most)

        least, upto = 0, 0
        while least <= most:
            yield from extend(0, space, (), all_bits, least, min(upto, most))
            least, upto = upto + 1, 4 * upto + 3

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for n, c in Counter(filling).items():
            self.left[n] = self.left.get(n, 0) - c * times
            if not self.left[n]:
                del self.left[n]

    def better(self, best: list, bound: int) -> tuple[list, bool]:
        """(best packing found, whether the search was whole)."""
        total = sum(n * c for n, c in self.left.items())
        pieces = sum(self.left.values())
        n_best = sum(n for _, n in best)
        path: list[tuple[tuple[int, ...], int]] = []
        used = waste = 0
        whole = True

        def open_node():
            first = max(self.left)
            self.take((first,), 1)
            out = first, list(self.fillings_limited(first, (n_best - 1) * self.capacity - total - waste, pieces))
            self.take((first,), -1)
            return iter(out[1])

        stack = [open_node()] if self.left else []
        while stack and n_best > bound:
            filling = next(stack[-1], None)
            if filling is None:
                stack.pop()
                if path:
                    f, times = path.pop()
                    self.take(f, -times)
                    used, waste, pieces = used - times, waste - times * (self.capacity - sum(f)), pieces + times * len(f)
                continue
            times = 1
            if pieces > SINGLE:  # too many to branch on each bin
                whole = False
                times = min(self.left[n] // c for n, c in Counter(filling).items())
            lost = times * (self.capacity - sum(filling))
            if waste + lost > (n_best - 1) * self.capacity - total:
                continue
            self.take(filling, times)
            path.append((filling, times))
            used, waste, pieces = used + times, waste + lost, pieces - times * len(filling)
            if not self.left:
                best, n_best = list(path), used
                stack.append(iter(()))
            else:
                stack.append(open_node())
        return best, n_best <= bound or (whole and self.budget > 0)

    def fillings_limited(self, first: int, most: int, pieces: int) -> Iterator[tuple[int, ...]]:
        """All fillings of a small instance; of a large one the ``BRANCHES`` first, so that a node costs little."""
        return islice(self.fillings(first, most), None if pieces <= SINGLE else BRANCHES)


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """([(lengths of a bin, number of such bins)], whether no packing has fewer bins).

    Branch and bound: the bin of the largest piece left is filled in every
    undominated way, least waste first, and each way is followed to the end
    unless its waste, together with that of the bins before, leaves no packing better than
    the best one.  Best-fit decreasing is the first of those; ``lower_bound`` ends
    the search.  Up to ``SINGLE`` pieces bins are branched on one by one and the
    result is optimal if ``nodes`` suffice; of more pieces a filling is used as often
    as counts allow, with ``BRANCHES`` ways at each node.
    """
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    if sum(n for _, n in best) <= bound:
        return best, True
    return _Search(counts, capacity, nodes).better(best, bound)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs (Martello and Toth's L2)."""
    best = 0
    lengths = sorted(counts)
    for k in {0, *(n for n in lengths if 2 * n <= capacity)}:
        big = sum(c for n, c in counts.items() if n > capacity - k)
        mid = [(n, c) for n, c in counts.items() if capacity >= 2 * n or n <= capacity - k]
        half = [(n, c) for n, c in mid if 2 * n > capacity and n <= capacity - k]
        small = sum(n * c for n, c in mid if 2 * n <= capacity and n >= k)
        room = sum((capacity - n) * c for n, c in half)
        best = max(best, big + sum(c for _, c in half) + max(0, -(-(small - room) // capacity)))
    return best


def ranges(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, number of it in a bin, first sequence, offset) for each length of each filling."""
    out, used, base = [], Counter(), 0
    for content, times in bins:
        offset = 0
        for length, c in sorted(Counter(content).items(), reverse=True):
            out.append((length, used[length], used[length] + c * times, c, base, offset))
            used[length] += c * times
            offset += c * length
        base += times
    return out


# -- documents ---------------------------------------------------------------


def most_ranges(capacity: int) -> int:
    """Rows of :func:`ranges` for which a broadcast is right; see :func:`pack_pieces`."""
    return 3 * capacity * math.isqrt(2 * capacity) + SINGLE


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice; give a stored table.  The driver holds only
    the histogram and the ranges.  Ranking splits each length into parts by
    a hash of the piece, so no task gets a whole hot length.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    parts = min(max(1, total // PART_ROWS), PARTS)
    keyed = pieces.withColumn("__part", F.pmod(F.xxhash64(pieces.columns[0], "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    by_part = keyed.groupBy("length", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    by_part = stored(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-parts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins, _ = complete_bins(counts, capacity, nodes)
    rows = ranges(bins) or [(0, 0, 0, 1, 0, 0)]
    places = spark.createDataFrame(rows, "__length long, __from long, __to long, __times long, __sequence long, __offset long")
    # Each step of a packing uses up a length or a kind of bin, of which best fit opens at most two for a length, and
    # a bin has at most sqrt(2 capacity) lengths: so many rows, whatever the number of pieces.
    if len(rows) <= most_ranges(capacity):
        places = F.broadcast(places)
    own = Window.partitionBy("length", "__part").orderBy(pieces.columns[0], "piece")
    # both are dealt and sorted by these columns for the window already; the parts grow with the corpus
    ranked = keyed.withColumn("__own", F.row_number().over(own) - 1).join(by_part.drop("n").hint("merge"), ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.col("before") + F.col("__own"))
    fits = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    at = F.col("__rank") - F.col("__from")
    return ranked.join(places, fits).select(
        *pieces.columns,
        (F.col("__sequence") + F.floor(at / F.col("__times"))).alias("sequence_id"),
        (F.col("__offset") + at % F.col("__times") * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, tokenizer: str, keep_ids: bool = True, **options) -> DataFrame:
    """Pieces of all documents with their ids, ``sequence_id`` and ``offset``."""
    pieces = tokenized_pieces(df, tokenizer, keep_ids=keep_ids, **options)
    return pack_pieces(stored(pieces, "packing"), options.get("capacity", CAPACITY))


def op1_packing(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = docs if docs is not None else spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return out.drop("ids")
