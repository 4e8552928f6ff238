"""Quality rules as a short-circuit cascade of built-in expressions.

Every rule is a Boolean column over per-document counts.  ``order_rules`` works out
each rule's cost and counts its rejections on a sample, and puts the rule next
that rejects most of what is left for its cost; ``cascade`` nests them in one CASE, so that a
document stops at the first rule that rejects it.  The order changes the work, never the
verdict, which is the disjunction of the rules.

Defined results: a null text has no words and fails the base test; an empty
table gives an empty result; extra columns are kept by ``apply_rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelog.llm.common import let, words

WINDOW = 8
MIN_WORDS = 20
#: Runs of characters that count as symbols.
SYMBOLS = "[#*$%&|<>]+"

#: Private column names; documents may have columns of any other name.
TEXT, WORDS, HASHES = "__qr_text", "__qr_words", "__qr_hashes"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the text and word columns to a Boolean column; it may use the counts by their names.

    ``chars`` and ``words`` are what it costs for each character and word of a text, in ns.
    """

    name: str
    rejects: object
    chars: float = 0.0
    words: float = 0.0


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))


def _capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{Lu}]+", ""))


#: Nanoseconds for each character that the patterns of letters and capitals pass over, and for each word of
#: array_distinct, as measured once on one core.
LETTERS, CAPITALS, DISTINCT = 13.0, 3.0, 100.0

#: Thresholds are loose: each marks text that no prose of any language reaches.
RULES = (
    Rule("symbols", lambda t, w: F.lit(100) * F.col("n_symbols") > F.lit(8) * F.col("word_chars")),
    Rule("capitals", lambda t, w: F.lit(2) * _capitals(t) > _letters(t), LETTERS + CAPITALS),
    Rule("few_letters", lambda t, w: F.lit(2) * _letters(t) < F.col("word_chars"), LETTERS),
    Rule("long_words", lambda t, w: F.col("word_chars") > F.lit(40) * F.col("n_words")),
    Rule("short_words", lambda t, w: F.lit(2) * F.col("word_chars") < F.lit(3) * F.col("n_words")),
    Rule("few_distinct_words", lambda t, w: F.lit(20) * F.size(F.array_distinct(w)) < F.size(w) - F.lit(2000), 0.0, DISTINCT),
)


def n_repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in ``hashes``.

    Texts without any repeat stop at the comparison of the two sizes.
    """

    def covered(order: Column) -> Column:
        twice = F.filter(
            order,
            lambda x, j: (F.get(order, j - 1)["h"] == x["h"]) | (F.get(order, j + 1)["h"] == x["h"]),
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
        )
        return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start, step, lambda acc: acc["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        let(pairs, covered)
    )


def _joined(hashes: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places behind: from runs of ``by`` words to runs of twice as many."""
    n = F.size(hashes) - by
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts as long columns, and the private text and word columns."""
    lines = F.filter(F.split(F.col(TEXT), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n = F.size(WORDS)
    hashes = F.when(
        n >= WINDOW,
        let(
            F.transform(WORDS, lambda w: F.xxhash64(w)),
            lambda h: let(_joined(h, 1), lambda two: let(_joined(two, 2), lambda four: _joined(four, 4))),
        ),
    ).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(TEXT, F.coalesce(F.col(text), F.lit(""))).withColumn(WORDS, words(F.col(TEXT)))
    df = df.withColumn(HASHES, hashes)
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(F.col(WORDS), "")).cast("long"),
            "n_symbols": (F.length(TEXT) - F.length(F.regexp_replace(TEXT, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": n_repeat_words(F.col(HASHES)),
        }
    ).drop(HASHES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def order_rules(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = 512
) -> list[tuple[Rule, float, float]]:
    """(rule, cost of a document, rejections) in the order that rejects most for its cost, from a sample.

    The sample holds about ``rows`` rows from all partitions, four times that at most (a parameter of this estimate; no
    document is dropped by it).  A rule's cost is that of its expressions over the sample's characters and words;
    it is worked out, not timed, so it is the same in each run and on each machine.
    Rejections are those of documents that neither the base test nor the rules before reject, so a
    rule that repeats another one goes to the end.  Ties keep the given order.
    """
    share = min(1.0, rows / max(1, df.count()))
    sample = df.select(F.coalesce(F.col(text), F.lit("")).alias("__qr_sample")).sample(share, seed=7).limit(4 * rows)
    flags = [rule.rejects(F.col(TEXT), F.col(WORDS)).alias(f"r{k}") for k, rule in enumerate(rules)]
    sizes = base_failed().alias("base"), F.length(TEXT).alias("chars"), F.size(WORDS).alias("words")
    left = [r for r in with_counts(sample, "__qr_sample").select(*sizes, *flags).collect() if not r["base"]]
    todo, out = dict(enumerate(rules)), []
    chars, words_ = (sum(r[c] for r in left) / max(1, len(left)) for c in ("chars", "words"))
    while todo:
        cost = {k: 1.0 + rule.chars * chars + rule.words * words_ for k, rule in todo.items()}
        hits = {k: sum(bool(r[f"r{k}"]) for r in left) for k in todo}
        # half a rejection more for each rule, so that rules that reject none are ordered by cost
        best = max(todo, key=lambda k: ((hits[k] + 0.5) / cost[k], -k))
        out.append((todo.pop(best), cost[best], float(hits[best])))
        left = [r for r in left if not r[f"r{best}"]]
    return out


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a document, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(F.col(TEXT), F.col(WORDS)), F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, ``base_failed``, ``rejected_by`` and ``kept``."""
    ordered = [rule for rule, _, _ in order_rules(df, text, rules)]
    out = with_counts(df, text).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop(TEXT, WORDS)


def filter_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose document is kept, with the input's columns."""
    ordered = [rule for rule, _, _ in order_rules(df, text)]
    # columns of the same names as the counts may be in the input
    private = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__qr_row"), F.col(text).alias(TEXT))
    # a condition that isn't deterministic stays where it is; else Catalyst would move the filter
    # below the counts and put the whole expression of the words in place of each use of them
    here = F.monotonically_increasing_id() >= 0
    out = with_counts(private, TEXT).withColumn("__qr_keep", here & ~base_failed() & cascade(ordered).isNull())
    return out.filter("__qr_keep").select("__qr_row.*")


# -- query -------------------------------------------------------------------


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_rules(docs)
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), c AS (
  SELECT doc_id, t, w, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM t
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS v
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM c WHERE n_words >= 8)
), r AS (
  SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1
), g AS (
  SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS d FROM r
), s AS (
  SELECT doc_id, sum(d) AS n FROM g GROUP BY doc_id
), a AS (
  SELECT c.*, coalesce(s.n, 0) AS n_repeat_words,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_distinct(w)) AS n_distinct
  FROM c LEFT JOIN s USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 8 * word_chars OR 2 * capitals > letters
            OR 2 * letters < word_chars OR word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words
            OR 20 * n_distinct < n_words - 2000) AS kept
FROM b
"""
