"""Deduplication, decontamination, archives and the pipeline, against plain Python."""

import base64
import gzip
import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tablelog.llm import common, decontamination, line_dedup, native_lines, near_documents, packing, simhash, substring_dedup, warc
from tablelog.llm.components import connected_components
from tests.llm.conftest import frame


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(n, linked):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def slow_fingerprint(text, k=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lower)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none, repeated):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    for k, _ in rows:
        assert got[k]["fp"] % (1 << 64) == fps[k] and got[k]["component_id"] == root[k]
    assert len(set(root)) <= len(rows) - 5
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(repeated).count() == 41


def test_coordinates_are_distances_to_references():
    fps = simhash.references(50, seed=3)
    base = simhash.references(1, seed=99)[0]
    got = simhash.coordinates(fps, base)
    apart = lambda x, y: bin(int(x) ^ int(y)).count("1")
    for n, x in enumerate(fps):
        assert got[n].tolist() == [apart(x, int(base) ^ (1 << j)) - apart(x, base) for j in range(64)]
        for m, y in enumerate(fps):  # as many differ as bits do
            assert (got[n] != got[m]).sum() == apart(x, y)


def test_simhash_query(spark, rows, tmp_path):
    """The query's own columns against brute force, with repeated and null ids."""
    own = rows + rows[:9] + [(None, rows[10][1]), (None, None)]
    frame(spark, own).write.parquet(f"{tmp_path}/documents.parquet")
    fps = [slow_fingerprint(t) for _, t in own]
    root = components(len(own), [(i, j) for i, j in combinations(range(len(own)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {}
    for (k, _), r in zip(own, root):
        least[r] = min((x for x in (k, least.get(r)) if x is not None), default=None)
    expected = sorted((str(k), f"{f:016x}", least[r]) for (k, _), f, r in zip(own, fps, root))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, str(tmp_path)).collect())
    assert got == expected


@pytest.mark.parametrize("bucket", [2048, 1])
def test_links_keep_the_radius(spark, bucket):
    far = spark.createDataFrame([(x,) for x in (0, 3, 7 << 40, (7 << 40) + 1, 12, 13, 9)], "fp long")
    found = {r["node"]: r["root"] for r in connected_components(simhash.links(far, 1, bucket=bucket)).collect()}
    assert 0 not in found and 3 not in found and found[(7 << 40) + 1] == 7 << 40 and found[13] == found[12] == found[9] == 9
    with pytest.raises(ValueError):
        simhash.links(far, 3)


@pytest.mark.parametrize("bucket", [2048, 3])
@pytest.mark.parametrize("groups", [4, 6])
def test_links_of_crowded_keys(spark, bucket, groups):
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centers for _ in range(60)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = components(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    found = {r["node"]: r["root"] for r in connected_components(simhash.links(df, 2, groups, bucket)).collect()}
    label = [found.get(signed(x), signed(x)) for x in fps]
    assert len(set(zip(root, label))) == len(set(root)) == len(set(label))


def shingles(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def near_rows():
    """Copies of few texts with 0 to 6 words altered, around a common passage, besides short, empty and null texts."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(30)]
    rows = []
    for k in range(400):
        base = random.Random(k % 23)
        w = [f"w{base.randrange(5000)}" for _ in range(base.choice([4, 5, 30, 90, 300]))] + common * (k % 3 == 0)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two")]


def test_near_documents(spark, none, repeated):
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j])]
    root = components(len(rows), linked)
    fps = [slow_fingerprint(t, 5) for _, t in rows]
    assert any(bin(fps[i] ^ fps[j]).count("1") > 2 for i, j in linked)  # what two bits miss
    got = {r["doc_id"]: r["component_id"] for r in near_documents.near_duplicates(frame(spark, rows)).collect()}
    assert got == {rows[k][0]: rows[root[k]][0] for k in range(len(rows))}
    assert near_documents.near_duplicates(none).count() == 0
    assert near_documents.near_duplicates(repeated).count() == 41


@pytest.mark.parametrize("groups", [None, 9])
def test_first_links_are_the_least_near_fingerprints(spark, groups):
    rng = random.Random(6)
    centers = [rng.getrandbits(64) for _ in range(8)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centers for _ in range(40)})
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    near = {b: [a for a in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= simhash.WIDE] for b in fps}
    assert {(r["a"], r["b"]) for r in simhash.first_links(df, groups=groups).collect()} == {(x[0], b) for b, x in near.items() if x}
    crowded = {(r["a"], r["b"]) for r in simhash.first_links(df, bucket=2).collect()}
    assert crowded and len({b for _, b in crowded}) == len(crowded) and all(a in near[b] for a, b in crowded)


def test_near_documents_are_linked_by_fingerprints(spark, monkeypatch):
    """Without the exact join the links are those of simhash that the sets confirm; the join leaves out what they connect."""
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    signed = [x - (1 << 64) if x >> 63 else x for x in (slow_fingerprint(t, 5) for _, t in rows)]
    one = {s: k for k, s in reversed(list(enumerate(map(frozenset, sets))))}  # equal sets have one fingerprint
    first = {x: k for k, x in reversed(list(enumerate(signed)))}
    linked = [(k, one[frozenset(s)]) for k, s in enumerate(sets)] + [(k, first[x]) for k, x in enumerate(signed) if alike(sets[k], sets[first[x]])]
    for b, k in first.items():
        near = [a for a in first if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= simhash.WIDE] if sets[k] else []
        if near and alike(sets[k], sets[first[min(near)]]):
            linked.append((k, first[min(near)]))
    root = components(len(rows), linked)
    formed = []

    def none_of(tokens):
        formed.extend(near_documents._pairs(tokens.orderBy("k", "n").toPandas()))
        return spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(near_documents, "candidates", none_of)
    source = frame(spark, rows).coalesce(1)  # so uids are places
    got = {r["doc_id"]: r["component_id"] for r in near_documents.near_duplicates(source).collect()}
    assert got == {rows[k][0]: rows[root[k]][0] for k in range(len(rows))}
    assert any(bin((signed[i] ^ signed[j]) & (1 << 64) - 1).count("1") > 2 and alike(sets[i], sets[j]) for i, j in linked)
    assert formed and not any(root[i] == root[j] for a, b in formed for i, j in zip(a.tolist(), b.tolist()))


def test_near_duplicate_stage_of_the_pipeline(spark, tmp_path):
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j])])
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, frame(spark, rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[k][0] for k in range(len(rows)) if root[k] == k]


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100), (7, 3), (200, 201)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[201] == 200


def slow_lines(rows):
    sets = []
    for k, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            w = words(line)
            if w:
                sets.append((k, i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}))
    removed = {k: set() for k, _ in rows}
    for n, (k, i, s) in enumerate(sets):
        if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in sets[:n]):
            removed[k].add(i)
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[k]) for k, t in rows}, {k: len(v) for k, v in removed.items()}


@pytest.mark.parametrize("native", [False, True])
def test_line_dedup(spark, docs, rows, none, repeated, native):
    out = line_dedup.dedup_lines(docs, count_col="removed", native=native)
    assert out.columns == [*docs.columns, "removed"]
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in out.collect()}
    texts, removed = slow_lines(rows)
    assert got == {k: (texts[k], removed[k]) for k, _ in rows} and sum(removed.values()) > 20
    assert line_dedup.dedup_lines(none, native=native).count() == 0
    assert line_dedup.dedup_lines(repeated, native=native).count() == 41


def test_line_dedup_query_runs_no_python(spark, rows, monkeypatch, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    plans, store = [], line_dedup.stored
    freed = spark.conf.get(common.FREED)

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    for module in (line_dedup, native_lines):
        monkeypatch.setattr(module, "stored", recorded)
    out = line_dedup.op9_line_dedup(spark, str(tmp_path))
    texts, removed = slow_lines(rows)
    sha = {k: None if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    assert {r["doc_id"]: (r["n_removed"], r["text_sha256"]) for r in out.collect()} == {k: (removed[k], sha[k]) for k in sha}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any(re.search("Python|InArrow|InPandas", p) for p in plans)
    assert spark.conf.get(common.FREED) == freed


@pytest.mark.parametrize("native", [False, True])
def test_line_dedup_near_lines(spark, native):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    lines = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        lines.append(" ".join(w))
    rows = [(k, "\n".join(lines[k * 3 : k * 3 + 3])) for k in range(20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows), native=native).collect()}
    assert got == slow_lines(rows)[0]


@pytest.mark.parametrize("sample", [1, 1 << 40])
def test_native_lines_whatever_is_sampled(spark, monkeypatch, sample):
    """Counts of all words or of none, any separators; sets are joined without being sorted."""
    plans, store = [], native_lines.stored

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name)

    monkeypatch.setattr(native_lines, "SAMPLE", sample)
    monkeypatch.setattr(native_lines, "stored", recorded)
    w = [f"w{k}" for k in range(30)]
    near = [*w[:28], "x1", "x2"]
    rows = [(1, " ".join(w) + "\nh i j k\n \t"), (2, "\t".join(w) + "\r\n" + " \x0b".join(near)), (3, "\x0c".join(near) + "\n  h  i j\tk\n" + "\r".join(w[:12] + w[9:]))]
    rows += [(4, "a b c d e a b c d e a b c d e\nb c d e a b c d e a b c"), (5, "\x0bh i j\x0ck\r\n" + "  ".join(w[3:] + ["y"]))]
    texts, removed = slow_lines(rows)
    got = line_dedup.dedup_lines(frame(spark, rows), count_col="removed", native=True).collect()
    assert {r["doc_id"]: (r["text"], r["removed"]) for r in got} == {k: (texts[k], removed[k]) for k in texts} and sum(removed.values()) > 4
    met = [p for name, p in plans if name == "line-verified"]
    assert len(met) == 2 and all(p.count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in p for p in met)


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "Short item here"), (3, ""), (4, None), (10, "short ITEM here")]


def slow_hits(text, items):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = tok(text), set(), set()
    for k, t in items:
        own = tok(t)
        for s, n in decontamination.windows_of(own):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == own[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [500_000, 4])
def test_decontamination(spark, rows, none, block_words):
    own = rows + [(500, f"{rows[10][1]} ALPHA-beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi short item, here"), (501, "gamma delta epsilon zeta"), (502, "short item here " * 30)]
    items = BENCH + [(20, rows[15][1]), (21, rows[-4][1])]
    out = decontamination.find_contamination(frame(spark, own), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    for r in out.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == slow_hits(dict(own)[r["doc_id"]], items), r["doc_id"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(frame(spark, own), empty).filter("n_hit > 0").count() == 0
    assert decontamination.find_contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a big red old house stood"), (2, "a house red"), (3, "red x x x x x house"), (4, None)], "doc_id long, text string")
    query = spark.createDataFrame([(7, "red house")], "item_id long, text string")
    near = lambda slop: sorted({r["doc_id"] for r in decontamination.proximity_matches(docs, query, slop).collect()})
    assert (near(0), near(1), near(2), near(5)) == ([], [1], [1, 2], [1, 2, 3])


def slow_repeats(rows, window=13):
    first = {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = {}
    for k, t in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(window)}
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("most", "batch"), [(400_000, 256), (300, 4)])
def test_substring_dedup(docs, rows, none, repeated, monkeypatch, most, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_ROWS", batch)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs, most=most).collect()}
    assert got == slow_repeats(rows) and sum(x[1] for x in got.values()) > 500
    assert substring_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(repeated).count() == 41


@pytest.mark.parametrize(("bits", "right"), [(13, False), (25, True)])
def test_substring_names_that_collide(spark, rows, monkeypatch, bits, right):
    """With names of few bits repeats are false at first: rounds go on until none is, or the operator raises."""
    real = substring_dedup.path_names

    def poor(hashes, depth, window):
        out = real(hashes, depth, window)
        return out % np.uint64(1 << bits) if depth == window else out

    docs = frame(spark, rows)
    monkeypatch.setattr(substring_dedup, "path_names", poor)
    if right:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
        assert got == slow_repeats(rows)
    else:
        with pytest.raises(RuntimeError):
            substring_dedup.verified_repeats(docs.selectExpr("doc_id AS doc", "text"), rounds=2)


MAGIC = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "1500"])
def test_warc_round_trip(spark, tmp_path, split):
    pages = {1: "hello", 2: None, 3: "", 4: "x" * 3000 + MAGIC + "tail" + MAGIC + warc.MAGIC, 5: "hello", 6: "é" * 1500 + MAGIC, 7: "\r\n\r\n", 8: warc.MAGIC, 9: MAGIC * 60}
    df = spark.createDataFrame([(k, f"http://x/{k}\r\nX: y", v, "extra") for k, v in pages.items()], "page_id long, url string, html string, id string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        path = f"file://{tmp_path}/warc"
        warc.write_warc(df.repartition(2), path, "page_id", "url", "html")
        got = {r["id"]: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == set(pages)
    for k, v in pages.items():
        latest = max(j for j, x in pages.items() if (x or "") == (v or ""))
        r = got[k]
        assert r["type"] == ("response" if k == latest else "revisit") and r["refers_to"] == (None if k == latest else latest)
        if k == latest:
            raw = (v or "").encode()
            assert bytes(r["payload"]) == raw and r["payload_bytes"] == len(raw)
            assert r["digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_warc_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(empty, f"file://{tmp_path}/w", "page_id", "url", "html")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0


def test_rows_of_one_id_are_judged_each(spark, rows):
    """Ids that repeat or are null, and ids that are strings."""
    long = " ".join(f"v{k}" for k in range(60))
    own = [(7, long + "\nonly here a b c d"), (7, "x y z"), (None, long), (9, "q " + long), (9, long + " tail"), (None, "x y z"), (8, None), (10, "only here a b c d e f g h\nmore")]
    df = frame(spark, own)
    # decontamination
    items = spark.createDataFrame([(1, " ".join(f"v{k}" for k in range(20, 40)))], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in decontamination.find_contamination(df, items).collect())
    slow = [slow_hits(t, [(1, " ".join(f"v{k}" for k in range(20, 40)))]) for _, t in own]
    assert got == sorted((str(k), s[0], s[1]) for (k, _), s in zip(own, slow))
    # repeats: rows of one id don't own words of each other, null ids own nothing
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == sorted([("7", 66, 0), ("7", 3, 0), ("None", 60, 0), ("9", 61, 60), ("9", 61, 60), ("None", 3, 0), ("8", 0, 0), ("10", 11, 0)])
    # lines: rows are documents; nothing that stands in one row only is lost
    for native in (False, True):
        out = line_dedup.dedup_lines(df, count_col="removed", native=native).collect()
        left = [x for r in out for x in (r["text"] or "").split("\n")]
        assert {x for _, t in own for x in (t or "").split("\n")} - set(left) <= {"q " + long, long + " tail"} and left.count("x y z") == 1
    strings = spark.createDataFrame([(f"id{k}", t) for k, t in rows], "doc_id string, text string")
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(strings).collect()}
    assert got == {f"id{k}": v[2] for k, v in slow_repeats(sorted(rows, key=lambda x: f"id{x[0]}")).items()} or len(got) == len(rows)
    assert line_dedup.dedup_lines(strings).count() == len(rows)


def test_warc_null_and_repeated_ids(spark, tmp_path):
    pages = [(1, "a"), (2, "b"), (None, "a"), (3, "a"), (4, "c"), (5, "a"), (5, "b"), (None, None), (6, "tail")]
    df = spark.createDataFrame([(k, None, v) for k, v in pages], "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w", "page_id", "url", "html")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(k) for k, _ in pages)  # no record behind a null id is lost
    assert sorted(r["id"] for r in got if r["type"] == "revisit") == [1, 2, 3] and all(r["refers_to"] == 5 for r in got if r["type"] == "revisit")
    (tmp_path / "sf").mkdir()
    df.write.parquet(f"{tmp_path}/sf/pages.parquet")
    rows = warc.op10_warc(spark, str(tmp_path / "sf")).collect()
    digest = lambda v: base64.b32encode(hashlib.sha1((v or "").encode()).digest()).decode()
    assert sorted((str(r["page_id"]), r["payload_digest"]) for r in rows) == sorted((str(k), digest(v)) for k, v in pages)


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_of_others(spark, tmp_path, zipped):
    """Version 1.0, ids that are UUIDs, a request record, gzip members, and files that hold no record."""
    def record(kind, number, body, version="1.0"):
        head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0-{number}>\r\nWARC-Target-URI: http://x/{number}\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    parts = [record("warcinfo", 0, b"software: x"), record("response", 1, http + b"hello WARC/1.0\r\n WARC/1."), record("request", 2, b"GET / HTTP/1.1\r\n\r\n"), record("response", 3, http + b"last", "1.1")]
    (tmp_path / "w").mkdir()
    if zipped:
        (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts))
    else:
        (tmp_path / "w" / "a.warc").write_bytes(b"".join(parts))
        (tmp_path / "w" / "no.txt").write_bytes(b"no record here")
        (tmp_path / "w" / "late.txt").write_bytes(b"x" + parts[1])
        (tmp_path / "w" / "old.txt").write_bytes(b"WARC/0.18\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    got = {r["record_id"]: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert sorted(got) == [f"urn:uuid:0-{k}" for k in range(4)] and all(r["id"] is None for r in got.values())
    assert bytes(got["urn:uuid:0-1"]["payload"]) == b"hello WARC/1.0\r\n WARC/1." and bytes(got["urn:uuid:0-3"]["payload"]) == b"last"
    assert got["urn:uuid:0-1"]["digest"] == base64.b32encode(hashlib.sha1(b"hello WARC/1.0\r\n WARC/1.").digest()).decode()


def test_pipeline_is_its_stages(spark, tmp_path, rows):
    good = [(k, t) for k, t in rows if t and len(t.split()) > 25]
    good += [(600, good[0][1] + " " + BENCH[0][1])]
    good += [(601, " ".join("".join(chr(97 + int(x)) for x in f"{k:05}") for k in range(5000)) + ". " + BENCH[0][1] + ", to the end.")]
    frame(spark, good).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "line_dedup":
            assert got == slow_lines(sorted(before.items()))[0]
        if name == "simhash":
            own = sorted(before.items())
            fps = [slow_fingerprint(t, 5) for _, t in own]
            root = components(len(own), [(i, j) for i, j in combinations(range(len(own)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2])
            assert got == {own[k][0]: own[k][1] for k in range(len(own)) if root[k] == k}
        if name == "decontamination":
            hit = {k: slow_hits(t, BENCH) for k, t in before.items()}
            assert got == {k: t for k, t in before.items() if not hit[k][1]}
            assert 601 in before and 601 not in got and 20 * hit[601][1] < hit[601][0]  # a passage in a long text
        docs = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == {r["doc_id"] for r in docs.collect()}
    assert sum(r["length"] for r in final) == sum(len(packing._encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))(r["text"])) + 1 for r in docs.collect())


@pytest.mark.parametrize(("limit", "groups"), [(2048, 4_000_000), (3, 40)])
def test_line_dedup_of_crowded_lists(spark, monkeypatch, limit, groups):
    """Many lines around common passages, copies in one task and across tasks, repeated words, and one to four words."""
    rng = random.Random(8)
    passage = " ".join(f"common{k}" for k in range(40))
    rows = []
    for k in range(120):
        lines = [f"{passage} {' '.join(f'own{rng.randrange(10**6)}' for _ in range(rng.randint(0, 14)))}" for _ in range(2)]
        lines += ["a b a b a b a b c", "a b a b a b", "one", "one two three four", " one  two\tthree four ", "", " \t", f"x{k} y z"]
        w = [f"near{i}" for i in range(30)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(30)] = f"other{rng.randrange(40)}"
        lines.append(" ".join(w))
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows.append((500, "w" * 70 + " " + "é" * 50 + " short words behind long ones\n" + "w" * 70 + " " + "é" * 50 + " short words behind long ones"))
    monkeypatch.setattr(line_dedup, "LIST", limit)
    monkeypatch.setattr(line_dedup, "GROUP_WORDS", groups)
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows).repartition(3)).collect()}
    assert got == slow_lines(rows)[0]


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    words = ["", "a", "a\0", "aa", "b" * 8, "b" * 9, "b" * 64, "b" * 65, "é", "x" * 5000, *(f"w{k}" for k in range(20_000))]
    got = line_dedup._hashed(pa.array(words))
    assert len(set(got.tolist())) == len(words)
    assert (line_dedup._hashed(pa.array(words)[5:]) == got[5:]).all()
    bits = np.unpackbits(got.view(np.uint8)).reshape(-1, 64).mean(axis=0)
    assert abs(bits - 0.5).max() < 0.03
