"""Secret scan with one deterministic automaton for all rules.

The rules become one minimal automaton over bytes (``automaton``), which finds
where matches of any rule end in a single pass; a small backwards automaton per
rule then finds where a match begins.  Lengths are checked last, on the span.

Defined results: a null or empty text has no spans; spans are code-point
offsets, end exclusive, leftmost and non-overlapping within a kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelog.llm.automaton import Automaton
from tablelog.llm.common import small_batches


@dataclass(frozen=True)
class SecretRule:
    """``accepts``, if any, must match a whole span for it to count."""

    kind: str
    pattern: str
    accepts: str = ""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The first three are the base kinds.  Rules whose failing matches still use up
#: text (assign, access) match any length and are checked by ``accepts``.
RULES = (
    SecretRule("assign", _ASSIGN + "[A-Za-z0-9+/_.=\\-]+", _ASSIGN + "[A-Za-z0-9+/_.=\\-]{12,}"),
    SecretRule("access", "AKIA[A-Z0-9]+", "[A-Z0-9]{18,}"),
    SecretRule("hex", "[0-9a-f]{16,}"),
    SecretRule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("hub_token", "gh[opsu]_[A-Za-z0-9]+", "gh[opsu]_[A-Za-z0-9]{36,}"),
    SecretRule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", ".{60,}"),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = rules
        self.forward = Automaton([r.pattern for r in rules])
        self.back = [Automaton([r.pattern], anywhere=False, backwards=True) for r in rules]
        self.accepts = [re.compile(r.accepts.encode()) if r.accepts else None for r in rules]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then by the order of the rules."""
        data = (text or "").encode()
        found = []
        for k, ends in self.forward.ends(data).items():
            used, check = 0, self.accepts[k]
            for end in ends:
                start = self.back[k].longest_back(data, end, used)
                if start < 0:
                    continue
                used = end
                if not check or check.fullmatch(data, start, end):
                    found.append((start, k, end))
        found.sort()
        if text and not text.isascii():  # bytes to code points, in one walk over the marks
            at, last, n = {}, 0, 0
            for mark in sorted({x for s, _, e in found for x in (s, e)}):
                n += len(data[last:mark].decode())
                at[mark], last = n, mark
            found = [(at[s], k, at[e]) for s, k, e in found]
        return [(self.rules[k].kind, s, e) for s, k, e in found]


@cache
def _scanner(rules: tuple[SecretRule, ...]) -> Scanner:
    return Scanner(rules)


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """One row per row of ``df``: the id and ``spans``.

    Each worker compiles the automaton once; no rows move between tasks.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in _scanner(rules).spans(t)]
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
        )

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """Matches of each rule between two marks, so that the lengths of what stands before give their places."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(r.kind)}, {k}, {quoted(r.pattern)}, {quoted(r.accepts)}, {r.kind in BASE})" for k, r in enumerate(RULES))
    return f"""
WITH r(kind, ord, pattern, accepts, base) AS (VALUES {rules}),
t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  SELECT doc_id, r.*, string_split(regexp_replace(t, '(' || pattern || ')', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS p FROM t, r
), i AS (
  SELECT *, unnest(range(2, len(p) + 1)) AS i FROM p WHERE len(p) > 1
), m AS (
  SELECT doc_id, kind, ord, accepts, base, split_part(p[i], chr(57345), 1) AS found,
    list_sum(list_transform(p[1:i - 1], lambda x: length(replace(x, chr(57345), ''))))::BIGINT AS s FROM i
), k AS (
  SELECT doc_id, kind, ord, base, s, kind || ':' || s || ':' || (s + length(found)) AS span FROM m WHERE accepts = '' OR regexp_full_match(found, accepts)
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE base) AS own, string_agg(span, ',' ORDER BY s, ord) AS spans
  FROM k GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = _oracle()
