from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import common, jaccard

from . import helpers as H


def brute(rows):
    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = H.SPACED.findall(H.lower(text or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    holds = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    up, links = {i: i for i in sets}, Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        common = Counter(j for x in s for j in holds[x] if j > i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    comp = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((doc, len(sets[i]), comp[root(i)], links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def ran(df):
    return sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=str)


@pytest.mark.parametrize("sizes", [(4096, 1024, 256), (4, 3, 2)])
def test_table_against_brute_force(spark, data, monkeypatch, sizes):
    for name, n in zip(("TILE", "WIDE_BLOCK", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(jaccard, name, n)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert ran(docs) == brute([(r["doc_id"], r["text"]) for r in H.table(data, "documents")])


def test_near_copies_in_blocks(spark, monkeypatch):
    for name in ("TILE", "WIDE_BLOCK", "BLOCK"):
        monkeypatch.setattr(jaccard, name, 3)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            w[k] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w[: 120 - int(rng.integers(0, 12))])))
    rows += [(100 + i, " ".join(f"v{rng.integers(0, 12)}" for _ in range(30))) for i in range(20)]
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    got = ran(H.odd(spark))
    assert got == brute([(r[0], r[1]) for r in H.ODD])
    assert jaccard.jaccard_components(H.empty(spark)).count() == 0


def test_threshold_is_inclusive(spark):
    # 8 words hold 4 shingles; 3 of 4 in both: 3 * 100 >= 75 * 4
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "a b c d e f")]
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_long_words_are_told_apart(spark):
    t = [0]
    for _ in range(12):
        t += [1 - x for x in t]
    rows = [(i, "".join("ab"[x] for x in y[:n])) for i, (n, y) in enumerate((n, y) for n in (1024, 2048, 4096) for y in (t, [1 - x for x in t]))]
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_hashes_come_last(spark, data, monkeypatch, hot):
    for name, n in (("SAMPLE", 1), ("HOT", hot), ("TILE", 4), ("WIDE_BLOCK", 3), ("BLOCK", 2)):
        monkeypatch.setattr(jaccard, name, n)
    common = " ".join(f"c{k}" for k in range(30))
    rng = np.random.default_rng(2)
    rows = [(i, common + " " + " ".join(f"v{k}" for k in rng.integers(0, 50, 12))) for i in range(40)]
    rows += [(100 + i, " ".join(f"u{k}" for k in range(60 - i % 9))) for i in range(30)] + [(r["doc_id"] + 1000, r["text"]) for r in H.table(data, "documents")[:60]]
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_half_digests_that_agree(spark, monkeypatch):
    whole = jaccard._digest
    monkeypatch.setattr(jaccard, "_digest", lambda s: (len(s) % 2, whole(s)[1]))
    rows = [(i, " ".join(f"w{k}" for k in range(i % 11, 20 + i % 7))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = {}
    for _, t in rows:
        s = jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
        met.setdefault(whole(s), jaccard._digest(s))
    shared = frozenset(d[0] for d in met.values())
    assert shared == {0, 1} and len({jaccard._name(d, shared) for d in met.values()}) == len(met) and ran(df) == brute(rows)


def test_components_with_a_hub(spark, monkeypatch):
    from foliant.llm import common

    monkeypatch.setattr(common, "HUB", 5)
    rng = np.random.default_rng(6)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if e[0] != e[1]} | {n: root(n) for n in got}
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1)


def test_few_edges_are_settled_without_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(0, -i) for i in range(60)] + [(100 + i, 101 + i) for i in rng.permutation(300).tolist()] + [(int(a), int(b)) for a, b in rng.integers(500, 900, (300, 2))] + [(2**62, -(2**62))]
    made, write = [], common.table
    monkeypatch.setattr(common, "table", lambda df, name: made.append(name) or write(df, name))
    of = lambda e: sorted(map(tuple, common.joined(spark.createDataFrame(e, "a long, b long")).collect()))
    few = of(edges)
    assert made == ["edges"] and of([]) == of([(3, 3)]) == []
    monkeypatch.setattr(common, "FEW_EDGES", len(edges) // 2)
    assert of(edges) == few and "small" in made
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}x{k}" for k in range(40)) + " end" * (i % 3)) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(common, "FEW_EDGES", 200_000)
    made.clear()
    kept = sorted(r["doc_id"] for r in jaccard.keep_first(docs).collect())
    assert kept == list(range(0, 30, 3)) and "small" not in made


def test_keep_first_of_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, b + " end", 1), (5, a, 2), (5, b, 3), (3, b + " end", 4), (None, a, 5), (7, None, 6), (7, "", 7), (None, "one two", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v int").withColumns({c: F.lit(1) for c in ("d", "_d", "m", "row", "k_id")})
    got = jaccard.keep_first(docs)
    assert got.columns == docs.columns and sorted((str(r["doc_id"]), str(r["text"])[:2]) for r in got.collect()) == [("3", "b0"), ("5", "a0"), ("7", ""), ("7", "No"), ("None", "on")]


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(1, 1 << 63, n, np.uint64))
        k = int(rng.integers(0, max(1, n // 6) + 1))
        b = np.unique(np.concatenate([a[k:], rng.integers(1, 1 << 63, k, np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 75 * (len(a) + len(b) - inter):
            continue
        w = min(jaccard.bits_of(len(a)), jaccard.bits_of(len(b)), jaccard.MOST_BITS)
        fold = [jaccard._fold([jaccard.bitmap(x, jaccard.bits_of(len(x)))], w)[0] for x in (a, b)]
        assert jaccard.may_link(len(a), len(b), int(np.bitwise_count(fold[0] ^ fold[1]).sum()))
        shared = len(np.intersect1d(jaccard.prefix(a), jaccard.prefix(b)))
        assert shared >= jaccard.least_shared(len(a)) and shared >= jaccard.least_shared(len(b))


def test_keep_first(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    comp = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert {r["doc_id"] for r in jaccard.keep_first(docs).collect()} == set(comp.values())


def test_long_texts_that_share_passages_form_no_group(spark, monkeypatch):
    """Texts too long for the tiles' bitmaps, every passage of which stands in a few others: each pair shares some keys, none enough of them."""
    rng, met = np.random.default_rng(5), []
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 100)) for _ in range(1000)]
    rows = [(i, " ".join(pool[j] for j in rng.choice(len(pool), 45, replace=False))) for i in range(60)]
    rows += [(100, rows[7][1] + " and more"), (101, rows[8][1][2:])]
    large = jaccard._large
    monkeypatch.setattr(jaccard, "_large", lambda c: met.append(max(r["count"] for r in c.groupBy("label").count().collect())) or large(c))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert max(met) == 2
    assert [r["component_id"] for r in got] == [*range(60), 7, 8] and [r["n_links"] for r in got] == [int(i in (7, 8)) for i in range(60)] + [1, 1]


@pytest.mark.parametrize("group", [1, 2, 3])
def test_crowded_keys_and_pairs_find_the_same(spark, data, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = np.random.default_rng(group)
    words = [f"v{x}" for x in rng.integers(0, 10**6, 400)]
    rows = [(i, " ".join(words[: 60 + 17 * (i % 9)] + [f"x{i}{j}" for j in range(int(rng.integers(0, 25)))])) for i in range(80)]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in H.table(data, "documents")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_keep_first_leaves_texts_where_they_are(spark, monkeypatch):
    """The rows that go are broadcast, whatever the texts' size; too many of them are joined, with the same result. Nulls, blanks and equal rows too."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "g h i"), (3, "g h i"), (None, "k l"), (None, None), (4, None), (4, ""), (5, "g h i"), (6, "x y z"), (None, None)], "doc_id long, text string")
    want = sorted([(1, "a b c d e f"), (3, "g h i"), (None, "k l"), (None, None), (None, None), (4, None), (4, ""), (6, "x y z")], key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = jaccard.keep_first(docs)
        first = df._jdf.queryExecution().optimizedPlan().toString()
        assert first.count("strategy=broadcast") == 2
        assert sorted(map(tuple, df.collect()), key=str) == want
        monkeypatch.setattr(jaccard, "BROADCAST_CLASSES", 0)
        assert sorted(map(tuple, jaccard.keep_first(docs).collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
