"""Quality rules, secrets, licenses, the classifier, and packing, against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablelog.llm import license_scan, packing, quality_classifier, quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for k, t in rows:
        expected = counts(t)
        assert tuple(got[k][c] for c in quality_rules.COUNTS) == expected, k
        assert got[k]["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert got[k]["kept"] == (got[k]["rejected_by"] is None)
    assert got[rows[-3][0]]["rejected_by"] == "capitals" and got[rows[-2][0]]["rejected_by"] in ("base", "symbols")


def test_quality_filter_keeps_rows_and_columns(docs, none, repeated):
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in quality_rules.apply_rules(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids and ids
    assert quality_rules.filter_documents(none).count() == 0
    assert quality_rules.filter_documents(repeated).count() == 2 * quality_rules.filter_documents(repeated.filter("doc_id is not null").distinct()).count()


def test_rule_order_changes_nothing(docs):
    rules = quality_rules.RULES
    a = quality_rules.apply_rules(docs, rules=rules).select("doc_id", "kept")
    b = quality_rules.apply_rules(docs, rules=rules[::-1]).select("doc_id", "kept")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    orders = [[(r.name, cost, hits) for r, cost, hits in quality_rules.order_rules(docs, rows=k)] for k in (10**6, 10**6, 40)]
    assert orders[0] == orders[1] and sorted(x[0] for x in orders[2]) == sorted(r.name for r in rules)
    assert all(cost > 0 for _, cost, _ in orders[0])


def test_rules_that_repeat_another_come_last(spark):
    """Rejections are counted among what the rules before leave."""
    docs = spark.createDataFrame([(k, "ALL IN CAPITAL LETTERS " * 10 + str(k) if k % 2 else "some text of small letters " * 10) for k in range(40)], "doc_id long, text string")
    docs = docs.withColumn("text", F.regexp_replace("text", "(\\w+)", "$1" + "x"))  # no repeated windows matter here
    capitals = quality_rules.RULES[1]
    again = quality_rules.Rule("again", capitals.rejects, capitals.chars * 1.5)
    none = quality_rules.Rule("none", lambda t, w: F.length(t) < 0, 0.1)
    base = quality_rules.base_failed
    try:
        quality_rules.base_failed = lambda: F.lit(False)
        out = quality_rules.order_rules(docs, rules=(again, none, capitals), rows=10**6)
    finally:
        quality_rules.base_failed = base
    hits = {r.name: h for r, _, h in out}
    assert hits["again"] == 0 and hits["none"] == 0 and [r.name for r, _, _ in out].index("again") > [r.name for r, _, _ in out].index("capitals")


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PARTS = ["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "==", "abcdef012345", "AKIA", "AKIAABCDEFGHIJ1234", "é", "漢", "0123456789abcdef", "x", "\n", "-", "tokentoken="]


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, e, k in sorted(out)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_secret_spans(text):
    found = secret_scan._scanner(secret_scan.RULES).spans(text)
    assert [x for x in found if x[0] in secret_scan.BASE] == base_spans(text)


def test_secret_scan(spark, docs, none):
    assert secret_scan.scan_secrets(none).count() == 0
    assert all(not r["spans"] for r in secret_scan.scan_secrets(docs).filter("doc_id < 3").collect())
    df = spark.createDataFrame([(1, "é token = 'abcdefabcdef0123456789' -----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    assert [tuple(x) for x in secret_scan.scan_secrets(df).first()["spans"]] == [("assign", 2, 33), ("hex", 11, 33), ("private_key", 35, 66)]


def test_license_alignment(docs, none):
    found = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(docs).collect()}
    (only,) = [v for v in found.values() if v]
    assert (only[0]["name"], only[0]["start"], only[0]["end"], only[0]["coverage"]) == ("MIT-notice", 0, 5, 1.0)
    assert license_scan.scan_licenses(none).count() == 0
    m = license_scan.Matcher()
    mit = license_scan.TEMPLATES["MIT"].split()
    edited = " ".join(mit[:30] + ["CHANGED", "WORDS"] + mit[32:])
    two = f"before {edited} between text {' '.join(mit)} after"
    spans = [(x["name"], x["coverage"]) for x in m.licenses(two)]
    assert [n for n, _ in spans] == ["MIT", "MIT"] and spans[0][1] < 1 == spans[1][1]
    assert not m.licenses(None) and not m.licenses(" ".join(mit[:40]))


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
def test_whole_license_is_itself_only(name):
    text = license_scan.TEMPLATES[name]
    assert [(x["name"], x["coverage"]) for x in license_scan.Matcher().licenses(f"Some words before. {text} Others behind.")] == [(name, 1.0)]


def test_licenses_and_their_relatives():
    names = lambda t: [x["name"] for x in license_scan.Matcher().licenses(t)]
    t = license_scan.TEMPLATES
    assert names(t["Apache-2.0"].split("APPENDIX")[0]) == ["Apache-2.0"]
    assert names(t["GPL-3.0"].split("How to Apply These Terms")[0]) == ["GPL-3.0"]
    assert names("Licensed under CC BY-NC 4.0") == ["CC-BY-NC-4.0-notice"]
    others = ["Licensed under CC BY-SA 4.0", "Licensed under CC BY 3.0", "Released under the BSD License", "Licensed under the Apache License, Version 1.1"]
    assert [names(x) for x in others] == [[]] * 4
    assert names(t["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")) in ([], ["AGPL-3.0-header"])
    assert names(f"{t['MIT']} {t['BSD-3-Clause']}") == ["MIT", "BSD-3-Clause"]


def common_words(a, b):
    """Length of a longest common subsequence: no alignment has more pairs."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_licenses_among_foreign_words():
    """Every way of hiding a template that leaves its words in order is found, and coverage is never more than it can be."""
    rng = random.Random(5)
    matcher = license_scan.Matcher()
    foreign = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-header", "Apache-2.0-header"):
        own = license_scan.words_of(license_scan.TEMPLATES[name])
        k = len(own) // 2
        hidden = {
            "middle": own[:k] + foreign(90) + own[k:],
            "after each": [x for w in own for x in (w, *foreign(1))],
            "few lost": [w for w in own if rng.random() > 0.08],
            "lost and foreign": [x for w in own if rng.random() > 0.08 for x in (w, *foreign(rng.randrange(3)))],
            "many behind each tenth": [x for j, w in enumerate(own) for x in (w, *foreign(40 * (j % 10 == 9)))],
        }
        for way, middle in hidden.items():
            text = foreign(300) + middle + foreign(300)
            got = [x for x in matcher.licenses(" ".join(text)) if x["name"] == name]
            keys = license_scan.KEYS.get(name, ())
            if all(f" {k} " in f" {' '.join(middle)} " for k in keys):
                assert len(got) == 1, (name, way)
                most = common_words(middle, own) / len(own)
                assert 0.8 <= got[0]["coverage"] <= most + 1e-9 and got[0]["coverage"] > most - 0.1
                assert 300 <= got[0]["start"] < got[0]["end"] <= 300 + len(middle)
    three = (" ".join(license_scan.words_of(license_scan.TEMPLATES["MIT"])) + " between them ") * 3
    assert [x["name"] for x in matcher.licenses(three)] == ["MIT"] * 3


def test_no_license_without_its_words():
    """Texts of a template's words in another order, or too few of them, hold none: a longest common subsequence says so."""
    rng = random.Random(6)
    matcher = license_scan.Matcher()
    for name in ("MIT", "ISC", "BSD-2-Clause"):
        own = license_scan.words_of(license_scan.TEMPLATES[name])
        for text in (rng.sample(own, len(own)), own[: int(0.75 * len(own))], own[len(own) // 3 :] + own[: len(own) // 3]):
            got = [x for x in matcher.licenses(" ".join(text)) if x["name"] == name]
            assert not got or common_words(text, own) >= 0.8 * len(own)


def test_license_query_counts_its_spans(spark, tmp_path):
    """The query's columns, with null, empty and repeated rows and clashing columns."""
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(1, f"x y {mit}", "c"), (1, f"x y {mit}", "c"), (2, None, "c"), (3, "", "c"), (4, f"{mit} and {mit}\nReleased under the MIT License", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, licenses string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, license_scan.op7_license_scan(spark, str(tmp_path)).collect()))
    n = len(license_scan.words_of(mit))
    assert got[:2] == [(1, 1, f"MIT:2:{n + 2}")] * 2 and got[2:4] == [(2, 0, ""), (3, 0, "")]
    assert got[4] == (4, 3, f"MIT:0:{n},MIT:{n + 1}:{2 * n + 1},MIT-notice:{2 * n + 1}:{2 * n + 6}")


@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_patience_pairs_increase(a, b):
    pairs = license_scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(license_scan.patience(a, a)) == len(a)


def test_classifier_on_held_out_rows(spark, none):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "small", "river", "runs", "down", "hill", "and", "stone,", "fields."]) + rng.choice("abcde") for _ in range(60))
    bad = lambda: " ".join(rng.choice(["###", "BUY!!", "NOW!!", "$$$", "|", "BUY!!"]) for _ in range(60))
    data = [(k, good() if k % 4 else bad(), int(bool(k % 4))) for k in range(400)] + [(1000, None, None), (1001, "", None)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_classifier.score_documents(docs, labels).collect()}
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 for r in out.values())
    held = [(r["score"] >= 0.5) == bool(data[k][2]) for k, r in out.items() if r["held_out"] and k < 1000]
    assert len(held) > 80 and sum(held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in out.items())
    # held-out labels are never read
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(docs, flipped).collect()}
    assert all(abs(again[k] - r["score"]) < 1e-9 for k, r in out.items())
    assert quality_classifier.score_documents(none.select("doc_id", "text"), labels).count() == 0
    no_labels = quality_classifier.score_documents(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in no_labels] == [0.5]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.05, 0.95), st.sampled_from([1e-6, 1e-3, 0.1]), st.integers(2, 40))
def test_fit_minimises_the_nonnegative_risk(seed, prior, ridge, n):
    """Few rows of many features: the negatives' part goes below 0, where a plain solution overfits."""
    rng = np.random.default_rng(seed)
    pos, unl = (np.c_[np.ones(k), rng.normal(size=(k, 8))] for k in (n, 2 * n))
    p, u = pos.T @ pos / len(pos), unl.T @ unl / len(unl)
    w = quality_classifier.fit(p, u, prior, ridge)
    least, _ = quality_classifier.risk(w, p, u, prior, ridge)
    # the same number from the rows
    part = ((1 + unl @ w) ** 2).mean() / 4 - prior * ((1 + pos @ w) ** 2).mean() / 4
    assert abs(least - (prior * ((1 - pos @ w) ** 2).mean() / 4 + max(0, part) + ridge * w @ w / 4)) < 1e-8
    assert least <= quality_classifier.risk(np.zeros(9), p, u, prior, ridge)[0] + 1e-12
    for scale in (1e-3, 1e-2, 0.1, 1):
        for step in rng.normal(size=(40, 9)) * scale:
            assert quality_classifier.risk(w + step, p, u, prior, ridge)[0] >= least - 1e-9


def test_classifier_is_its_definition(spark):
    """Scores from all rows in one place: features, halves, prior and fit; rows that repeat, clashing columns, two labels."""
    q = quality_classifier
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(["stone", "river,", "hill", "runs", "A", "$$$", "BUY!!"][(k % 5 > 3) * 3 :]) for _ in range(rng.randint(1, 80)))
    data = [(k, text(k)) for k in range(150)] + [(200, None), (201, "")]
    data += data[:20]
    labels = [(k, int(k % 5 < 4)) for k in range(0, 150, 2)] + [(4, 1), (6, None), (300, 1)]
    docs = spark.createDataFrame([(k, t, "c", 1.0) for k, t in data], "doc_id long, text string, x string, held_out double")
    got = sorted((r["doc_id"], r["score"]) for r in q.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    x = {k: q.features(t).astype(float) for k, t in data}
    half = dict(spark.createDataFrame([(k,) for k in x], "id long").selectExpr("id", "xxhash64(id) & 1").collect())
    unl = [k for k, _ in data if not held(k)]
    pos = [k for k, y in labels if y == 1 and not held(k) for j, _ in data if j == k]
    moment = lambda ks: sum(np.outer(x[k], x[k]) for k in ks) / len(ks)
    ridge = max(q.RIDGE, 2 / len(unl))
    counts = np.zeros((2, q.BINS), np.int64)
    for h in (0, 1):
        tells = q.telling(moment([k for k in pos if half[k] != h]), moment([k for k in unl if half[k] != h]), ridge)
        for n, ks in enumerate((pos, unl)):
            for k in ks:
                if half[k] == h:
                    counts[n][q._binned(x[k][None], tells)[0]] += 1
    w = q.fit(moment(pos), moment(unl), q.prior_of(*counts), ridge)
    expected = sorted((k, min(1.0, max(0.0, (x[k] @ w + 1) / 2))) for k, _ in data)
    assert [k for k, _ in got] == [k for k, _ in expected]
    assert np.allclose([s for _, s in got], [s for _, s in expected], atol=1e-6)


def test_prior_of_mixtures():
    """Histograms of a mixture: a share of positives at high scores, the rest below."""
    bins = np.arange(quality_classifier.BINS)
    one, zero = (np.exp(-(((bins - m) / 100) ** 2) / 2) for m in (1300, 700))
    for prior in (0.05, 0.3, 0.86):
        counts = [np.rint(1e6 * x / x.sum()).astype(np.int64) for x in (one, prior * one + (1 - prior) * zero)]
        assert abs(quality_classifier.prior_of(*counts) - prior) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_bins_hold_all_pieces(counts_):
    bins, _ = packing.complete_bins(counts_, 64)
    used = Counter()
    for content, times in bins:
        assert sum(content) <= 64 and times > 0
        for n in content:
            used[n] += times
    assert used == Counter(counts_)
    total = sum(t for _, t in bins)
    assert packing.lower_bound(counts_, 64) <= total <= sum(t for _, t in packing.best_fit(counts_, 64))


def packed(out, capacity):
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, rows, none, repeated):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    out = packing.pack_documents(docs, path, capacity=128).collect()
    expected = {}
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 128 if len(ids) > 128 else len(ids)
        starts = [0, *range(first, len(ids), 128)] if first and len(ids) > first else list(range(0, len(ids), 128)) if not first else [0]
        for piece, s in enumerate(starts):
            e = starts[piece + 1] if piece + 1 < len(starts) else len(ids)
            expected[k, piece] = (s, ids[s:e])
    assert {(r["doc_id"], r["piece"]): (r["start"], r["ids"]) for r in out} == expected
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    used = packed(out, 128)
    assert used <= packing.lower_bound(Counter(r["length"] for r in out), 128) + 2
    assert packing.pack_documents(none, path).count() == 0
    packed(packing.pack_documents(repeated, path).collect(), 1024)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcXYZ019 \t\n\r'’sé漢字😀.,!?<|endoftext|>_-", max_size=60))
def test_fast_tokens_are_the_tokenizers(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert packing._encoder(path)(text) == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "hello", "\n", "é", "漢", "<", "1"]), max_size=12).map("".join))
def test_tokens_with_added_tokens_are_the_unmodified_tokenizers(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing._encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_of_added_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "hello <|endoftext|> world")], "doc_id long, text string")
    (row,) = packing.pack_documents(df, path).collect()
    ids = Tokenizer.from_file(path).encode("hello <|endoftext|> world", add_special_tokens=False).ids + [packing.END_ID]
    assert (row["ids"], row["length"], row["ids_crc32"]) == (ids, 5, zlib.crc32(np.array(ids, "<u4").tobytes()))


def fewest_bins(items, capacity):
    """Least bins by dynamic programming over subsets: (bins, filled of the last)."""
    best = [(1, 0)] + [(len(items) + 1, 0)] * ((1 << len(items)) - 1)
    for m, (bins, filled) in enumerate(best):
        for i, n in enumerate(items):
            if not m >> i & 1:
                best[m | 1 << i] = min(best[m | 1 << i], (bins, filled + n) if filled + n <= capacity else (bins + 1, n))
    return best[-1][0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=10), st.sampled_from([1, 2, 3]))
def test_packing_is_optimal_on_small_instances(items, parts):
    items = [-(-n // parts) for n in items]
    bins, proven = packing.complete_bins(Counter(items), 64)
    assert proven and sum(t for _, t in bins) == fewest_bins(items, 64)
    assert sum((Counter({k: c * t for k, c in Counter(f).items()}) for f, t in bins), Counter()) == Counter(items)


def test_packing_branches_on_bins():
    """Cases that best fit, and one least-waste filling after another, get wrong."""
    for capacity, items in ((64, (11, 12, 12, 16, 18, 21, 27, 27, 27, 34, 44)), (1024, (192, 217, 229, 281, 306, 352, 480, 489, 526))):
        bins, proven = packing.complete_bins(Counter(items), capacity)
        assert proven and sum(t for _, t in bins) == fewest_bins(items, capacity) < sum(t for _, t in packing.best_fit(Counter(items), capacity)) + (capacity == 64)


@pytest.mark.parametrize("hot", [0, 30_000])
def test_ranges_are_few(hot):
    rng = random.Random(4)
    counts_ = Counter(rng.randint(1, 1024) for _ in range(40_000)) + Counter({7: hot, 1024: hot})
    bins, _ = packing.complete_bins(counts_, 1024)
    rows = packing.ranges(bins)
    assert len(rows) <= packing.most_ranges(1024)
    ends = Counter()
    for length, start, end, times, _, offset in sorted(rows):
        assert start == ends[length] and (end - start) % times == 0 and offset + times * length <= 1024
        ends[length] = end
    assert ends == counts_


@pytest.mark.parametrize("length", [1, 1023, 1024, 1025, 2048, 2049, 5000])
def test_cut(length):
    pieces = packing.cut(length, 1024)
    assert sum(n for _, n in pieces) == length and all(n == 1024 for _, n in pieces[1:])
    assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
