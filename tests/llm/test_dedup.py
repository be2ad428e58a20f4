import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from climekin.llm import components, exact_dedup, near_dedup, substring_dedup
from climekin.llm.suffix_array import common_prefixes, suffix_array
from tests.llm.common import DOCS, EDGE, files, frame


def exact_groups(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    return {t: (max((k for k in ks if k is not None), default=None), len(ks)) for t, ks in groups.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, tmp_path, weak):
    docs = files(spark, tmp_path, EDGE).withColumn("digest", F.lit(1)).withColumn("file", F.lit("f"))
    # A weak digest makes all texts of one length clash: full bytes decide.
    options = {"digest": lambda t: F.length(t).cast("string").cast("binary")} if weak else {}
    want = exact_groups(EDGE)
    got = exact_dedup.dedup_report(docs, **options).collect()
    assert len(got) == len(EDGE)
    for r in got:
        keep, n = next(v for t, v in want.items() if (r["doc_id"], t) in [(k, x or "") for k, x in EDGE] and (weak or r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, n, r["doc_id"] == keep)
    kept = exact_dedup.deduplicate(docs, **options)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in want.values())


def test_exact_repeated_rows_and_frames_without_files(spark):
    docs = frame(spark, [(1, "a"), (1, "a"), (None, "b"), (None, "b")])
    assert [r["text"] for r in exact_dedup.deduplicate(docs).orderBy("text").collect()] == ["a", "b"]
    assert sorted(r["group_size"] for r in exact_dedup.dedup_report(docs).collect()) == [2, 2, 2, 2]
    assert exact_dedup.dedup_report(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_goes_on_from_its_state(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first, second = files(spark, tmp_path / "1", [(1, "a"), (2, "b")]), files(spark, tmp_path / "2", [(3, "a"), (4, "c")])
    exact_dedup.dedup_report(first, state=state).collect()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_report(second, state=state).collect()}
    assert got == {3: (3, 2), 4: (4, 1)}


def test_exact_bytes_across_runs(spark, tmp_path):
    """A digest that clashes with an earlier run's is resolved by the texts of both."""
    state = f"file://{tmp_path}/state"
    weak = {"digest": lambda t: F.length(t).cast("string").cast("binary"), "state": state}
    runs = [[(1, "aa"), (2, "c")], [(3, "bb"), (4, "c")], [(5, "aa"), (6, "bb"), (7, "dd")]]
    seen = []
    for n, rows in enumerate(runs):
        seen += rows
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_report(files(spark, tmp_path / str(n), rows), **weak).collect()}
        groups = exact_groups(seen)
        assert got == {k: groups[t] for k, t in rows}


def test_exact_repeated_run(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    docs = files(spark, tmp_path, [(1, "a"), (2, "a"), (3, "b")])
    want = sorted(exact_dedup.dedup_report(docs, state=state).collect())
    assert sorted(exact_dedup.dedup_report(docs, state=state).collect()) == want
    # Without files a run needs a name to be known again.
    rows = frame(spark, [(9, "b"), (8, "c")])
    for _ in range(2):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_report(rows, state=state, run="second").collect()}
        assert got == {9: (9, 2, True), 8: (8, 1, True)}


def test_exact_column_named_like_sparks_own(spark, tmp_path):
    for docs in (frame(spark, EDGE), files(spark, tmp_path, EDGE)):
        docs = docs.withColumn("_metadata", F.lit("mine"))
        assert exact_dedup.dedup_report(docs).count() == len(EDGE)
        kept = exact_dedup.deduplicate(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in exact_groups(EDGE).values())


def words(r, n):
    return [f"w{x}" for x in r.integers(0, 50_000, n)]


def near_rows(seed=3):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(30):
        base = words(r, int(r.integers(3, 120)))
        for _ in range(int(r.integers(1, 6))):
            text = list(base)
            for _ in range(int(r.integers(0, 4))):
                text[int(r.integers(0, len(text)))] = "edit" + str(r.integers(0, 99))
            rows.append((k, "  ".join(text).upper() if r.random() < 0.2 else " ".join(text)))
            k += 1
    return rows


def word_sets(rows):
    """Sets of five-word strings, made without the operator's code."""
    out = {}
    for k, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows, percent):
    sets = word_sets(rows)
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("percent", [85, 60])
def test_near(spark, percent, monkeypatch):
    np.seterr(over="ignore")
    rows = near_rows() + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "two one")]
    want = brute(rows, percent)
    docs = frame(spark, rows).selectExpr("*", "1 AS node", "2 AS k", "3 AS bands")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_report(docs, percent=percent, bands=30, rows=3 if percent < 80 else 4).collect()}
    assert got == want
    kept = near_dedup.deduplicate(docs, percent=percent, bands=30, rows=3 if percent < 80 else 4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)


def test_near_hot_group_without_a_common_centre(spark):
    """Many variants of one text, each a link of few others: every round takes more members."""
    r = np.random.default_rng(8)
    base = words(r, 150)
    rows = []
    for k in range(60):
        text = list(base)
        for i in range(3):
            text[(2 * k + 7 * i) % 150] = f"e{k}-{i}"
        rows.append((k, " ".join(text)))
    want = brute(rows, 85)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_report(frame(spark, rows)).collect()}
    assert got == want


def test_overlaps():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 400, int(n)).astype(np.uint64)) for n in r.integers(1, 300, 40)]
    left, right = np.arange(0, 25), np.arange(10, 40)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert near_dedup.overlaps(sets, left, right).tolist() == want
    # By incidence matrices, too.
    many = [np.unique(r.integers(0, 3000, 2500).astype(np.uint64)) for _ in range(120)]
    both = np.arange(120)
    assert near_dedup.overlaps(many, both, both).tolist() == [[len(np.intersect1d(a, b)) for b in many] for a in many]


@pytest.mark.parametrize("small", [False, True])
def test_near_variants_around_the_threshold(spark, monkeypatch, small):
    """1,500 variants of three texts, near 0.66, 0.84 and 0.86: links leave tasks as fewer rows than there are members."""
    if small:
        # Buckets are dealt over many tasks.
        monkeypatch.setattr(near_dedup, "CELL_MEMBERS", 60)
    r, rows = np.random.default_rng(5), []
    for part, edits in enumerate((5, 2, 2)):
        base = words(r, 150 if part < 2 else 190)
        for _ in range(500):
            text = list(base)
            for i in r.integers(0, len(text), edits):
                text[int(i)] = f"e{r.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(text)))
    made, connect = [], near_dedup.relabel
    monkeypatch.setattr(near_dedup, "relabel", lambda labels, links, tables: (made.append(links.count()), connect(labels, links, tables))[1])
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_report(frame(spark, rows)).collect()}
    # Texts of different parts share no shingle.
    assert got == {k: c for a in range(0, 1500, 500) for k, (_, c) in brute(rows[a : a + 500], 85).items()}
    assert sum(made) <= (20 if small else 3) * len(rows)


def test_near_recall(spark):
    """Pairs of all similarities, each on its own: links found of those there are."""
    r, rows = np.random.default_rng(6), []
    for k in range(600):
        base = words(r, 120)
        text = list(base)
        for i in r.integers(0, 120, int(r.integers(1, 4))):
            text[int(i)] = f"e{r.integers(0, 10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(text))]
    want = {k for k, (_, c) in brute_pairs(rows).items() if c != k}
    got = {x["doc_id"] for x in near_dedup.near_report(frame(spark, rows)).collect() if not x["kept"]}
    assert got <= want and len(want) > 200 and len(got) >= 0.99 * len(want)


def brute_pairs(rows):
    sets = word_sets(rows)
    return {k: (len(s), k - 1 if k % 2 and 100 * len(s & sets[k - 1]) >= 85 * len(s | sets[k - 1]) else k) for k, s in sets.items()}


def test_near_very_long_text(monkeypatch):
    """Parts of a text and of its shingles give what the whole gives."""
    r = np.random.default_rng(7)
    text = " ".join(words(r, 5000)) + "\n\tEnd  of it"
    with np.errstate(over="ignore"):
        whole = near_dedup.shingles(text)
        one = near_dedup.superminhash(whole, np.zeros(len(whole), np.int64), 1, 125)
        monkeypatch.setattr(near_dedup, "TEXT_BYTES", 100)
        monkeypatch.setattr(near_dedup, "BATCH_SHINGLES", 64)
        parts = near_dedup.shingles(text)
        assert parts.tolist() == whole.tolist()
        assert (near_dedup.superminhash(parts, np.zeros(len(parts), np.int64), 1, 125) == one).all()


def test_near_edges(spark):
    docs = frame(spark, [*EDGE, (4, "a b c d e f g")])
    got = near_dedup.near_report(docs).collect()
    assert len(got) == len(EDGE) + 1
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got}
    assert by[4] == (1, False) and by[7] == (6, False) and by[2] == (2, True) and by[3] == (3, True) and by[None][1]
    assert near_dedup.near_report(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("start", [1, (1 << 63) - 50])
def test_near_texts_under_one_id(spark, start):
    r = np.random.default_rng(4)
    a, b, c = (words(r, 200) for _ in range(3))
    near = {n: " ".join([*t[:-1], "changed"]) for n, t in (("a", a), ("b", b), ("c", c))}
    a, b, c = (" ".join(t) for t in (a, b, c))
    ids = {"one": start, "five": start + 4, "six": start + 5, "seven": start + 6, "nine": start + 8}
    rows = [("one", a), ("five", near["a"]), ("five", b), ("five", c), ("seven", near["b"]), ("nine", near["c"]), ("six", "p q r s t u"), ("six", "p q r s t u")]
    docs = frame(spark, [(ids[n], t) for n, t in rows])
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in near_dedup.near_report(docs).collect())
    want = [("one", "one", True), ("five", "one", False), ("five", "five", True), ("five", "five", True), ("seven", "five", False), ("nine", "five", False), ("six", "six", True), ("six", "six", True)]
    assert got == sorted((ids[k], ids[v], kept) for k, v, kept in want)
    kept = sorted((x["doc_id"], x["text"]) for x in near_dedup.deduplicate(docs).collect())
    assert kept == sorted((ids[n], t) for n, t in [rows[0], rows[2], rows[3], rows[6], rows[7]])


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        pool = r.integers(0, 2**63, 400).astype(np.uint64)
        a, b = pool[:300], pool[100:]
        both = np.concatenate((a, b))
        h = near_dedup.superminhash(both, np.repeat([0, 1], 300), 2, 250)
        assert abs((h[0] == h[1]).mean() - 0.5) < 0.12
        # Each rank of one element goes to another slot.
        one = near_dedup.superminhash(pool[:1], np.zeros(1, np.int64), 1, 125)
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(125))


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
@settings(max_examples=5, deadline=None)
def test_components(spark, links):
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        if a != b:
            up[b] = a
    got = components.connect(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in {y for l in links for y in l} if find(x) != x}


def test_components_of_a_chain(spark):
    links = spark.range(3001).selectExpr("(id * 7919) % 3001 AS i").selectExpr("i AS u", "i + 1 AS v").repartition(7)
    assert components.connect(links.where("u < 3000")).where("root <> 0").count() == 0


@given(st.one_of(st.binary(max_size=70), st.text(alphabet="ab", max_size=70).map(str.encode), st.text(alphabet="a", max_size=40).map(str.encode)))
@settings(max_examples=300, deadline=None)
def test_suffix_array(text):
    a = np.frombuffer(text, np.uint8)
    sa = suffix_array(a)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    if len(text):
        shared = common_prefixes(a, sa, np.array([0]), 128)
        for p, q in zip(sa, sa[1:]):
            n = 0
            while max(p, q) + n < len(text) and text[p + n] == text[q + n]:
                n += 1
            assert shared[q] == n


def cut_brute(rows, length=50):
    seen, out = {}, {}
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for q in range(len(b) - length + 1):
            seen.setdefault(b[q : q + length], k)
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for q in range(len(b) - length + 1):
            if k is not None and seen[b[q : q + length]] < k:
                gone[q : q + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.setdefault(k, set()).add((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substrings(spark, monkeypatch, small):
    if small:
        # Several shards with several groups each.
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2000)
        monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 1500)
    r = np.random.default_rng(4)
    passages = [" ".join(words(r, 25)) for _ in range(5)]
    rows = []
    for k in range(80):
        parts = [" ".join(words(r, int(r.integers(0, 30))))]
        for _ in range(int(r.integers(0, 3))):
            p = passages[int(r.integers(0, 5))]
            a = int(r.integers(0, 60))
            parts += [p[a : a + int(r.integers(40, 120))], "".join(words(r, 2))]
        rows.append((k, "ü".join(parts)))
    rows += [(100, "ab" * 300), (101, "ab" * 200), (102, "a" * 49), (103, "a" * 50), (104, "a" * 51), (105, rows[0][1]), (106, rows[0][1]), *[(110 + k, t) for k, t in EDGE if k], (None, "a" * 80)]
    docs = frame(spark, rows).selectExpr("*", "1 AS row", "2 AS block", "3 AS spans")
    want = cut_brute(rows)
    got = substring_dedup.cut_repeats(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) in want[x["doc_id"]]
        assert hashlib.sha256(bytes(x["kept"])).hexdigest() == x["kept_sha256"]


def test_substrings_in_small_parts(spark, monkeypatch):
    rows = [(1, "xyz" * 400), (2, "q" + "xyz" * 300), (3, "".join(chr(97 + i * i % 26) for i in range(900)))] + [(k, "pre" * k + "".join(chr(97 + i * i % 26) for i in range(k, 400))) for k in (5, 6, 7)]
    want = cut_brute(rows)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 200)
    out = []
    with np.errstate(over="ignore"):
        for keys, data, starts, ends, bases in substring_dedup._gather([_batch(rows)], (0, 1)):
            first, stop, text, f = substring_dedup.anchors(data, starts, ends)
            out += [(data[a:b], keys[t][0], a - int(starts[t]) + bases[t]) for a, b, t in zip(first, stop, text)]
    # Every window of every text lies in one segment exactly.
    for k, t in rows:
        windows = sorted(q for s, d, at in out if d == k for q in range(at, at + len(s) - 49))
        assert windows == list(range(len(t) - 49))
    assert want


def test_near_dedup_keeps_workers_small(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sign = spark.conf.get(name, None), near_dedup._sign

    def checked(*options):
        work = sign(*options)

        def small(batches):
            def seen():
                for batch in batches:
                    assert batch.num_rows <= 1000
                    yield batch

            return work(seen())

        return small

    monkeypatch.setattr(near_dedup, "_sign", checked)
    rows = [(k, f"one text of many words that has number {k // 2} in it") for k in range(2500)]
    got = near_dedup.near_report(frame(spark, rows).coalesce(1)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {k: k // 2 * 2 for k, _ in rows}
    assert spark.conf.get(name, None) == before


def test_near_dedup_releases_memory(monkeypatch):
    calls = []
    monkeypatch.setattr(near_dedup, "release_memory", lambda: calls.append(1), raising=False)
    for work in (near_dedup._sign(2, 2, 5), near_dedup._sets(5), near_dedup._link(85)):
        assert list(work(iter([]))) == []
    assert len(calls) == 3


def test_only_long_matches_reach_the_arrays():
    # Texts that share 30 bytes send no segment; those that share LENGTH bytes do, wherever the anchor lies.
    r = np.random.default_rng(7)
    letters = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8)).decode()
    phrases = [letters(30) for _ in range(50)]
    rows = [(k, "".join(letters(int(r.integers(60, 90))) + p for p in phrases)) for k in range(20)]
    with np.errstate(over="ignore"):
        assert _sent(rows) == []
        for _ in range(100):
            passage = letters(substring_dedup.LENGTH)
            assert [np.frombuffer(x, "<i8").tolist() for x in _spans([(1, "<" + passage + "." + letters(40)), (2, letters(40) + ">" + passage + "|")])] == [[41, 91]]


def _segments(rows):
    import pyarrow as pa

    keyed = [(0, 1, k, k, t.encode()) for k, t in rows]
    of = lambda rows, kinds: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], list("abcde")[: len(kinds)])
    counts = list(substring_dedup._count(1)(iter([of([(b, k, t) for b, _, k, _, t in keyed], (pa.int32(), pa.int64(), pa.binary()))])))
    hits = [(0, 0, 0, s, f) for x in substring_dedup._shared(iter(counts)) for s, f in zip(x["shard"].to_pylist(), x["prints"].to_pylist())]
    return list(substring_dedup._segments(1, 1)(iter([of(hits + keyed, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))])))


def _sent(rows):
    return [d for x in _segments(rows) for d, kind in zip(x["docs"].to_pylist(), x["kind"].to_pylist()) if kind == 1]


def _spans(rows):
    return [s for x in substring_dedup._merge(substring_dedup._judge(iter(_segments(rows)))) for s in x["spans"].to_pylist()]


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t.encode() for _, t in rows], pa.binary())], ["k", "t"])


def test_substrings_of_nothing(spark):
    assert substring_dedup.cut_repeats(spark.createDataFrame([], DOCS)).count() == 0
