"""WARC archives: write, and read back by boundary-chain verification.

Writing: one record per row through Spark's text writer, so any file system
that Spark reaches will do and the commit protocol covers lost executors.
Payloads that occur more than once are stored once; the row with the largest id
is the response and the others revisit it.

Reading: the text reader splits the archives at the record magic, wherever it
stands, so magic inside a payload gives false candidates.  Each task emits, for
each candidate, its offset and the offset where its header says the next record
begins.  From offset 0 of each file, pointer jumping keeps the candidates that
the chain reaches; what lies between two of them is payload of the first.

Versions 1.0 and 1.1 are read, also from gzip files (one split each).

Defined results: a null payload is empty; a row with a null id is a response with
its payload; repeated ids have a record for each row, and rows that tie for the
largest id of a payload are all responses; an archive that doesn't begin with a record
has none; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelog.llm.common import shared_folder, small_batches, stored

MAGIC = "WARC/1.1\r\n"
#: What all versions begin with; the reader cuts here and looks at the rest.
CUT = "WARC/1."
VERSIONS = b"1\r\n", b"0\r\n"
#: End of every record.
GAP = "\r\n\r\n"
#: Records of one archive file at most, so that one file's offsets stay few.
RECORDS_PER_FILE = 50_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 5 hex digits are 4 digits of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    # a line break in a value would end the header
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]+", " "), F.lit("\r\n"))


def write_warc(
    df: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, date: str = "1970-01-01T00:00:00Z", least: int = 0
) -> None:
    """Write a record for each row; payloads of ``least`` bytes or more are stored once.

    Only digests are shuffled to find the copies, and counts of them combine
    before the shuffle, so a payload that a third of the rows share is no
    burden.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    long_enough = F.octet_length("payload") >= least
    latest = rows.filter(long_enough).groupBy("digest").agg(F.max("id").alias("of"), F.count("*").alias("n"))
    # stored first: its size is known when the join is planned, so few copies leave the payloads where they are
    copied = stored(latest.filter("n > 1").select("digest", "of"), "warc-copied")
    rows = rows.join(copied, "digest", "left")
    revisit = F.coalesce(long_enough & (F.col("of") != F.col("id")), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length("payload")),
        F.lit("\r\n"),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                _line("WARC-Refers-To", urn(F.col("of"))),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    out = rows.select(record.alias("value"))
    out.write.option("maxRecordsPerFile", RECORDS_PER_FILE).option("lineSep", GAP).mode("overwrite").text(path)


#: Header fields that the reader returns.  Numbers stay text until the end: pandas has no nullable ones by default.
FIELDS = {
    "id": rb"\r\nWARC-Record-ID: *<urn:page:(-?\d{1,18})>",
    "url": rb"\r\nWARC-Target-URI: *([^\r\n]*)",
    "type": rb"\r\nWARC-Type: *([^\r\n]*)",
    "refers_to": rb"\r\nWARC-Refers-To: *<urn:page:(-?\d{1,18})>",
    "record_id": rb"\r\nWARC-Record-ID: *<([^>\r\n]*)>",
    "stated": rb"\r\nWARC-Payload-Digest: *sha1:([^\r\n]*)",
}
LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r?\n?")
HEADER = [*FIELDS]
_HEADER = ", ".join(f"{n} string" for n in HEADER)
PIECE = "file", "block", "at"
_PIECE = "file string, block bigint, at bigint"
CANDIDATES = f"{_PIECE}, size bigint, next bigint, whole boolean, {_HEADER}, payload_bytes bigint, digest string, payload binary"
RECORDS = f"{_HEADER}, payload_bytes bigint, digest string, payload binary"
RECORD_NAMES = [*HEADER, "payload_bytes", "digest", "payload"]
#: Records without payloads; of a record that spans pieces also where they are, else an empty list.
CHAINED = f"{_HEADER}, payload_bytes bigint, digest string, {_PIECE}, start bigint, next bigint, pieces array<struct<block:bigint,at:bigint>>"
CHAIN_NAMES = [*HEADER, "payload_bytes", "digest", *PIECE, "start", "next", "pieces"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic; (file, block) is a split, read in order by one task."""
    small_batches(spark)
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """(file, block, at, bytes) of each piece; ``at`` is its offset within the split."""
    split, at = None, 0
    for b in batches:
        rows = []
        for file, block, piece in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
            if split != (file, block):
                split, at = (file, block), 0
            rows.append((file, block, at, piece))
            at += len(piece) + len(CUT)
        yield rows


def _payload_columns(record_type: str | None, block: bytes, keep: bool) -> dict:
    if record_type == "revisit":
        return {"payload_bytes": None, "digest": None, "payload": None}
    payload = block.partition(GAP.encode())[2]  # what follows the HTTP headers
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"payload_bytes": len(payload), "digest": digest, "payload": payload if keep else None}


def _described(piece: bytes, keep: bool) -> dict:
    """What the header of a piece (the bytes behind its magic) states, and its payload if the piece holds it all.

    ``next`` is where the header says the record ends, counted from its magic.
    """
    head, gap, rest = piece.partition(GAP.encode())
    head = b"\r\n" + head + b"\r\n"
    out: dict = {"next": -1, "whole": False, "payload_bytes": None, "digest": None, "payload": None}
    for name, pattern in FIELDS.items():
        m = re.search(pattern, head)
        out[name] = m and m[1].decode("utf-8", "replace")
    if gap and piece.startswith(VERSIONS) and (m := LENGTH.search(head)) and len(m[1]) < 19:
        length = int(m[1])
        out["next"] = len(CUT) + len(piece) - len(rest) + length + len(GAP)
        if length + len(GAP) == len(rest):
            out |= {"whole": True} | _payload_columns(out["type"], rest[:length], keep)
    return out


def candidates(spark: SparkSession, path: str, keep: bool) -> DataFrame:
    """One row for each magic in the archives, with its successor's offset, from the tasks that read them."""
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in CANDIDATES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _placed(batches):
            out = [
                {"file": f, "block": b, "at": at, "size": len(x), **_described(x, keep)} for f, b, at, x in rows
            ]
            yield pa.RecordBatch.from_pylist(out, schema)

    return _pieces(spark, path).mapInArrow(run, CANDIDATES)


def reachable(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Pointer jumping from offset 0: which candidates the chain of successors reaches."""
    n = len(start)
    place = np.minimum(np.searchsorted(start, after), n - 1)
    hop = np.append(np.where(start[place] == after, place, n), n)  # n: no record there
    seen = np.zeros(n + 1, dtype=bool)
    seen[0] = start[0] == 0
    while True:  # after k rounds: all within 2**k - 1 hops
        more = seen.copy()
        more[hop[np.flatnonzero(seen)]] = True
        done = np.array_equal(more, seen) and (hop[hop] == hop).all()
        seen, hop = more, hop[hop]
        if done:
            return seen[:n]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame | None:
    """Absolute offsets and reachable records of one file, None if it doesn't begin with a record."""
    pdf = pdf.sort_values(["block", "at"], kind="stable", ignore_index=True)
    size = pdf["size"].to_numpy()
    # the first piece is what stands before the first magic; each later one follows its own
    start = np.r_[0, np.cumsum(size + len(CUT))[:-1]][1:] - len(CUT)
    pdf = pdf[1:].reset_index(drop=True)
    if not len(pdf) or size[0]:
        return None
    kept = reachable(start, np.where(pdf["next"] >= 0, start + pdf["next"].to_numpy(), -1))
    end = np.r_[start[1:], start[-1] + len(CUT) + size[-1]]
    kept &= pdf["next"].to_numpy() >= 0
    owner = np.maximum.accumulate(np.where(kept, np.arange(len(kept)), -1))
    out = pdf[kept].assign(start=start[kept])
    first, last = np.searchsorted(owner, out.index), np.searchsorted(owner, out.index, side="right")
    # a last record whose bytes end early is no record
    out["cut"] = end[last - 1] < out["start"].to_numpy() + out["next"].to_numpy()
    out["pieces"] = [
        [] if w else [{"block": b, "at": a} for b, a in zip(pdf["block"][i:j].tolist(), pdf["at"][i:j].tolist())]
        for w, i, j in zip(out["whole"], first, last)
    ]
    return out.loc[~out["cut"], CHAIN_NAMES]


def _joined(pdf: pd.DataFrame, keep: bool) -> pd.DataFrame:
    """One record whose payload holds magic, from its pieces."""
    pdf = pdf.sort_values(["block", "at"], kind="stable", ignore_index=True)
    record = CUT.encode() + CUT.encode().join(pdf["value"])
    head, _, rest = record.partition(GAP.encode())
    length = int(pdf["next"][0]) - len(head) - 2 * len(GAP)
    out = pdf.loc[:0, HEADER].assign(payload_bytes=None, digest=None, payload=None)
    for name, value in _payload_columns(pdf["type"][0], rest[:length], keep).items():
        out[name] = pd.Series([value], dtype=object)
    return out[RECORD_NAMES]


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """:func:`_chain` of each file of sorted candidates; a file's offsets and headers are held, its payloads are not."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for file, rows in b.groupby("file", sort=False):
            if held and held[0]["file"].iloc[0] != file:
                out = _chain(pd.concat(held, ignore_index=True))
                held = []
                if out is not None:
                    yield out
            held.append(rows)
    out = _chain(pd.concat(held, ignore_index=True)) if held else None
    if out is not None:
        yield out


def read_warc(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """(id, url, type, refers_to, record_id, stated, payload_bytes, digest, payload) of every record that a chain from offset 0 reaches.

    ``id`` and ``refers_to`` are the numbers of this module's own archives, null in others; ``record_id``
    and ``stated`` are the record's id and payload digest as its header has them.  Sizes and digests
    are of the bytes read; a revisit has none.  Without ``keep`` payloads are null and none is
    moved, but for those that hold magic.
    """
    placed = candidates(spark, path, False).drop("payload").repartition("file").sortWithinPartitions("file", "block", "at")
    found = stored(placed.mapInPandas(_chains, CHAINED), "warc-chain")
    numbers = {n: F.col(n).cast("long") for n in ("id", "refers_to")}
    out = found.filter(F.size("pieces") == 0)
    if keep:
        payloads = candidates(spark, path, True).filter("whole").select(*PIECE, "payload")
        out = out.join(payloads, [*PIECE])
    else:
        out = out.withColumn("payload", F.lit(None).cast("binary"))
    out = out.select(*RECORD_NAMES)
    spanning = found.filter(F.size("pieces") > 0)
    if spanning.isEmpty():
        return out.withColumns(numbers)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*PIECE, "value"])

    wanted = spanning.select(*HEADER, "file", "start", "next", F.explode("pieces").alias("p"))
    wanted = wanted.select("*", "p.block", "p.at").drop("p")
    again = _pieces(spark, path).mapInArrow(pieces, "file string, block bigint, at bigint, value binary")
    rows = again.join(wanted, [*PIECE])
    return out.union(rows.groupBy("file", "start").applyInPandas(lambda pdf: _joined(pdf, keep), RECORDS)).withColumns(numbers)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    write_warc(pages, path, "page_id", "url", "html")
    records = stored(read_warc(spark, path, keep=False), "warc-records")
    first = records.filter("type = 'response'").select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    again = records.filter("type = 'revisit'")
    again = again.select(F.col("id").alias("again_id"), F.col("refers_to").alias("page_id"), F.col("stated").alias("payload_digest"))
    known = first.drop("refers_to", "record_type").distinct()
    again = again.join(known, ["page_id", "payload_digest"]).select(
        F.col("again_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.lit("revisit").alias("record_type"), F.col("page_id").alias("refers_to"),
    )
    return first.union(again)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS latest FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(d, 1 + 5 * (k // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31)::INTEGER, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM r
"""
