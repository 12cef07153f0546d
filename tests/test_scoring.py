import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import interfaces, stemming
from foliant.functions.interfaces import HashedVectors
from foliant.operators import coherence, matching, sampling, scoring, signal, summary


def pairs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, candidate string, reference string")


def by(df, col="f"):
    return {r["k"]: r[col] for r in df.collect()}


def test_rouge_n(spark):
    rows = [("the cat sat", "the cat sat"), ("a a b", "a b b"), ("", "x"), (None, None), ("x", "y"), ("The Cat!", "the cat")]
    got = by(scoring.rouge_n(pairs(spark, *rows), 1, ["k"]))
    assert [round(got[i], 6) for i in range(6)] == [1.0, 0.666667, 0.0, 0.0, 0.0, 1.0]
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("abc", k=rng.randint(0, 9))), " ".join(rng.choices("abc", k=rng.randint(0, 9)))) for _ in range(40)]
    for n in (1, 2):
        got = by(scoring.rouge_n(pairs(spark, *rows), n, ["k"]))
        for i, (c, r) in enumerate(rows):
            g = lambda t: Counter(tuple(t.split()[j : j + n]) for j in range(len(t.split()) - n + 1))
            hit, nc, nr = sum((g(c) & g(r)).values()), sum(g(c).values()), sum(g(r).values())
            assert got[i] == pytest.approx(2 * hit / (nc + nr) if hit else 0.0)


def test_rouge_l(spark):
    assert scoring.rouge_l_score("police killed the gunman", "police kill the gunman")[2] == 0.75
    assert scoring.rouge_l_score("a b c d", "a c b d")[0] == 0.75 and scoring.rouge_l_score("", "x") == (0.0, 0.0, 0.0)
    # the union of what two candidate lines have in common with one reference line
    assert scoring.rouge_lsum_score("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5")[1] == 0.8
    got = by(scoring.rouge_l(pairs(spark, ("a b", "a b"), (None, "x")), ["k"]))
    assert got == {0: 1.0, 1: 0.0}


def test_lcs_equals_the_plain_table():
    rng = random.Random(4)
    for _ in range(60):
        a, b = (rng.choices("abcd", k=rng.randint(0, 90)) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        at = sorted(scoring.lcs_places(a, b))
        rest = iter(b)
        assert scoring.lcs(a, b) == t[-1][-1] == len(at) and all(a[i] in rest for i in at)


def test_unions_of_spread_tables_are_merged(spark, data):
    from foliant.sources import files

    d = files.spread(spark.read.parquet(f"{data}/documents.parquet").select("doc_id"))
    twice = d.withColumn("ord", F.col("doc_id") * 2).unionByName(d.withColumn("ord", F.col("doc_id") * 2 + 1))
    assert len(matching.last_of(twice).collect()) == len(d.collect())


#: Words and their stems from the algorithm's description.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall",
    "hissing": "hiss", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "hopefulness": "hope", "triplicate": "triplic", "goodness": "good", "revival": "reviv", "adoption": "adopt",
    "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "sky": "sky", "as": "as",
}


def test_stems():
    assert {w: stemming.stem(w) for w in STEMS} == STEMS


def test_stemmed_scores(spark):
    rows = [("police killed the gunman", "police kill the gunmen"), ("Motoring cats", "motors cat!"), ("", "x"), (None, None)]
    plain = by(scoring.rouge_n(pairs(spark, *rows), 1, ["k"]))
    got = by(scoring.rouge_n(pairs(spark, *rows), 1, ["k"], stem=stemming.stem))
    assert (plain[0], got[0]) == (0.5, 0.75) and (plain[1], got[1]) == (0.0, 1.0) and got[2] == got[3] == 0.0
    for summary_level in (False, True):
        assert by(scoring.rouge_l(pairs(spark, *rows), ["k"], summary_level, stem=stemming.stem)) == got


def test_corpus_mean(spark):
    p = pairs(spark, ("a", "a"), ("", "a"), ("b", "c")).selectExpr("'m' as model", "*")
    r = scoring.corpus_mean(scoring.rouge_n(p, 1, ["model", "k"]), p, ["model", "k"], ["model"]).first()
    assert (r["n"], r["f"]) == (2, 50.0)
    none = p.where("candidate = ''")
    assert scoring.corpus_mean(scoring.rouge_n(none, 1, ["model", "k"]), none, ["model", "k"], ["model"]).first()["f"] == 0.0


@pytest.mark.parametrize("limit", [100_000, 0])
def test_greedy_match(spark, data, monkeypatch, limit):
    monkeypatch.setattr(interfaces, "MATRIX_ROWS", limit)
    enc = HashedVectors(spark.read.parquet(f"{data}/embeddings.parquet"))
    got = {r["k"]: (round(r["precision"], 6), round(r["recall"], 6)) for r in scoring.greedy_match(pairs(spark, ("a b c", "a b c"), ("", "x"), ("a b", "a")), enc, ["k"]).collect()}
    assert got[0] == (1.0, 1.0) and got[1] == (0.0, 0.0) and got[2][1] == 1.0 and got[2][0] < 1


def test_scorer_failures_stay_with_their_pair(spark):
    def scorer(cs, rs):
        if "bad" in cs:
            raise RuntimeError("no memory")
        return [len(c) for c in cs]

    got = {r["k"]: (r["score"], r["error"]) for r in scoring.scored_safely(pairs(spark, ("a", "r"), ("bad", "r"), (" ", "r"), ("abc", "r")), scorer, ["k"], filler=-10.0).collect()}
    assert got == {0: (1.0, None), 1: (-10.0, "no memory"), 2: (-10.0, None), 3: (3.0, None)}


def test_matching(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, summary string")
    right = spark.createDataFrame([(0, 1, "x"), (1, 1, "y"), (2, 2, "z"), (3, 9, "q")], "ord long, doc_id long, summary string")
    assert sorted((r["doc_id"], r["summary_right"]) for r in matching.match_two(left, right).collect()) == [(1, "y"), (2, "z")]
    assert sorted(r["doc_id"] for r in matching.match_two(left, right, first=2).collect()) == [1]
    a = spark.createDataFrame([(1, "d", "r"), (2, "d", None)], "doc_id long, document string, reference string")
    b = spark.createDataFrame([(2, "e", None), (3, "d", "r")], "doc_id long, document string, reference string")
    r = matching.match_report(a, b).first()
    assert (r["common"], r["only_in_left"], r["only_in_right"], r["same_document"], r["same_reference"], r["overlap_pct"]) == (1, 1, 1, 0, 1, 50.0)
    assert [r["doc_id"] for r in matching.not_done(left, right).collect()] == [3]


def test_samples(spark):
    assert sampling.shuffled_ids(10, 4) == sorted(sampling.shuffled_ids(10, 4)) and len(set(sampling.sampled_ids(100, 30))) == 30
    assert sampling.chosen_ids(50, 5) == sampling.chosen_ids(50, 5)
    with pytest.raises(ValueError):
        sampling.chosen_ids(sampling.MOST_POSITIONS + 1, 3)
    ok = sampling.shard_report(sampling.shard(sampling.ids_frame(spark, list(range(10))), 4)).collect()
    assert [r["n"] for r in sorted(ok, key=lambda r: r["shard"])] == [4, 4, 2] and all(r["in_order"] and not r["overlap"] for r in ok)
    bad = sampling.shard_report(sampling.shard(sampling.ids_frame(spark, [5, 6, 1, 5]), 2)).orderBy("shard").collect()
    assert [r["overlap"] for r in bad] == [1, 1] and not bad[1]["in_order"]


def test_summaries(spark):
    s = spark.createDataFrame([(i, m, "f", v) for m, vs in {"a": [0.0, 2.0, 4.0], "b": [0.0, 0.0, 0.0]}.items() for i, v in enumerate(vs)], "k long, model string, metric string, value double")
    p = {r["model"]: r for r in summary.positive_summary(s).collect()}
    assert (p["a"]["n_samples"], p["a"]["n_failed"], p["a"]["mean"], p["a"]["std"]) == (2, 1, 3.0, 1.0) and (p["b"]["n_samples"], p["b"]["mean"]) == (0, 0.0)
    assert [(r["model"], r["rank"]) for r in summary.model_ranking(s, "f").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert summary.metric_diff(s, "a").first()["difference"] == 2.0
    sweep = spark.createDataFrame([(0.1, "f", 1.0), (0.2, "f", 1.0), (0.3, "f", 0.5)], "alpha double, metric string, value double")
    assert summary.best_setting(sweep).first()["alpha"] == 0.1
    runs = spark.createDataFrame([(0.1, 1), (0.1, 2), (0.2, 1), (0.2, 2)], "alpha double, doc_id long")
    assert summary.sweep_consistency(runs).first()["status"] == "PASSED" and summary.sweep_consistency(runs.where("not (alpha = 0.2 and doc_id = 2)")).first()["status"] == "FAILED"


def test_wilcoxon(spark):
    d = [1.5, -0.5, 2.0, 2.0, 0.0, -3.0]
    p = spark.createDataFrame([("m", x, 0.0) for x in d], "g string, a double, b double")
    r = summary.wilcoxon(p, ["g"]).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (5, 2 + 3.5 + 3.5, 1 + 5) and r["mean_diff"] == pytest.approx(np.mean(d))
    var = 5 * 6 * 11 / 24 - (2**3 - 2) / 48
    assert r["z"] == pytest.approx((6 - 7.5) / var**0.5)
    assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / 2**0.5), abs=1e-6) and not r["significant"]
    rng = random.Random(3)
    d = [round(rng.gauss(0.01, 0.1) + (3 if rng.random() < 0.1 else 0), 2) for _ in range(500)]
    r = summary.wilcoxon(spark.createDataFrame([("m", x, 0.0) for x in d], "g string, a double, b double"), ["g"]).first()
    own = sorted(abs(x) for x in d if x)
    rank = {x: (own.index(x) + 1 + len(own) - own[::-1].index(x)) / 2 for x in set(own)}
    assert r["w_plus"] == sum(rank[abs(x)] for x in d if x > 0) and r["w_minus"] == sum(rank[abs(x)] for x in d if x < 0) and r["significant"]


def test_signal_rows_match_the_machine(spark, data):
    from foliant.operators import chunking

    rng = np.random.default_rng(2)
    words = [" ".join(rng.choice(list("abcdef"), 5)) for _ in range(12)]
    vec = rng.normal(size=(12, 3))
    df = spark.createDataFrame([(0, i, 5, w, [float(x) for x in v]) for i, (w, v) in enumerate(zip(words, vec, strict=True))], "doc_id long, pos int, n int, sentence string, vector array<double>")
    rows = signal.smoothed_rows(signal.hybrid_rows(df, 0.7)).orderBy("pos").collect()
    h = chunking.hybrid_signal(vec, [set(w.split()) for w in words], 0.7)
    assert np.allclose([r["hybrid"] for r in rows], h) and np.allclose([r["smoothed"] for r in rows], chunking.smooth(h), atol=1e-6)
    cut = signal.split_candidates(signal.smoothed_rows(signal.hybrid_rows(df, 0.7)), 10).first()
    from foliant.config import ChunkConfig

    assert cut["split_after"] == chunking.split_point([5] * 12, vec, [set(w.split()) for w in words], ChunkConfig(max_tokens=100, min_tokens=10, overlap_tokens=1))


def test_coherence(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)] + [(1, 0, [1.0, 0.0])], "g long, pos int, vector array<double>")
    got = {r["g"]: r for r in coherence.local_coherence(df, ["g"]).collect()}
    assert got[0]["local_coherence"] == 0.5 and (got[1]["local_coherence"], got[1]["coherence_variance"]) == (1.0, 0.0)
    assert {(r["i"], r["j"]): round(r["similarity"], 6) for r in coherence.similarity_matrix(df, ["g"]).collect()} == {(0, 1): 0.5, (0, 2): 1.0, (1, 2): 0.5}
    long = spark.createDataFrame([(0, i, [1.0, float(i)]) for i in range(12)], "g long, pos int, vector array<double>")
    assert coherence.global_coherence(long, ["g"], 2).first()["hierarchical_coherence"] > 0.5


def test_vectors_in_blocks(spark, data, monkeypatch):
    """A table of more rows than a block is sent in blocks, one held at a time, and gives the vectors that one block does."""
    from foliant.functions.interfaces import Matrix

    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = spark.createDataFrame([("a b c",), ("d e",), (" ",)], "s string")
    want = [r["vector"] for r in HashedVectors(table).attach(rows, "s").collect()]
    score = lambda: [(round(r["precision"], 9), round(r["recall"], 9)) for r in scoring.greedy_match(pairs(spark, ("a b c", "a b d"), ("", "x"), ("a b", "a")), HashedVectors(table), ["k"]).orderBy("k").collect()]
    whole = score()
    monkeypatch.setattr(interfaces, "MATRIX_ROWS", 25)
    monkeypatch.setattr(interfaces, "HELD", 1)
    enc = HashedVectors(table)
    assert enc.small and isinstance(enc.sent(), Matrix) and len(enc.sent().blocks) == -(-table.count() // 25) > 1
    got = enc.attach(rows, "s")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    got = [r["vector"] for r in got.collect()]
    assert got[2] is None and want[2] is None and all(np.allclose(x, y) for x, y in zip(got[:2], want[:2], strict=True)) and score() == whole


@pytest.mark.parametrize("name", ["cosine_adjacent", "hybrid_signal", "coherence_local", "coherence_global", "chunk_coherence", "similarity_matrix"])
def test_no_vector_is_shuffled(spark, data, monkeypatch, name):
    """Sentences are encoded where they stand, and give what the joined and windowed vectors give."""
    from foliant import queries

    shown = lambda df: sorted((tuple(f"{x:.5f}" if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    df = queries.QUERIES[name](spark, data)
    assert "vector" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = shown(df)
    monkeypatch.setattr(interfaces, "MATRIX_ROWS", 0)
    want = shown(queries.QUERIES[name](spark, data))
    near = lambda r, s: all(x == y or (abs(float(x) - float(y)) < 2e-5 if isinstance(x, str) else False) for x, y in zip(r, s, strict=True))
    assert len(got) == len(want) > 0 and all(map(near, got, want))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["split_candidates", "alpha_sweep"])
def test_no_sentence_is_shuffled(spark, data, monkeypatch, name):
    """The places to split after are found in the document's row, at all weights, and are those of the windows over sentences."""
    from foliant import queries
    from foliant.plans import experiments

    df = queries.QUERIES[name](spark, data)
    assert "Window" not in plan(df) and "Join" not in plan(df) and plan(df).count("Aggregate") == (name == "alpha_sweep")
    rows = signal.hybrid_rows(queries._neighbours(spark, data))
    if name == "split_candidates":
        smooth = signal.smoothed_rows(rows.withColumn("hybrid", F.round("hybrid", 9))).withColumn("smoothed", F.round("smoothed", 8))
        want = signal.split_candidates(smooth).select("doc_id", "cum_at", "split_after", F.round("score", 6).alias("score"))
    else:
        wide = rows.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in experiments.ALPHAS]))).withColumn("hybrid", F.expr("alpha * cosine + (1 - alpha) * jaccard_norm"))
        cut = signal.split_candidates(signal.smoothed_rows(wide, key="doc_id, alpha"), key="doc_id, alpha")
        want = cut.groupBy("alpha").agg(F.count("*").alias("n_docs"), F.round(F.avg("split_after"), 2).alias("mean_split"))
    got, want = sorted(map(tuple, df.collect())), sorted(map(tuple, want.collect()))
    assert got == want and len(got) > 0
    monkeypatch.setattr(interfaces, "MATRIX_ROWS", 0)  # a large encoder's signals come as rows
    assert len(queries.QUERIES[name](spark, data).collect()) == len(got)


def test_split_places_odd_groups():
    """Short groups, values that are not numbers, and equal values: the first of the lowest."""
    one = np.array([1.0])
    places = lambda n, c, least=1: signal.split_places(np.array(n), np.array(c, float), np.zeros(len(n)), one, least, (None, None))
    assert places([3, 3], [0.5, 0.1], 7) is None
    at, cum, score = places([3, 3, 3], [0.5, 0.5, 0.5], 4)
    assert (at[0], cum[0], score[0]) == (1, 6, 0.5)
    assert places([3, 3, 3], [float("nan"), 0.5, 0.2])[0][0] == 2 and places([3] * 4, [0.1, 0.5, 0.2, 0.4])[0][0] == 2


@pytest.mark.parametrize("name", ["chunk_coherence", "chunk_quality_stats", "coherence_global", "similarity_matrix"])
def test_chunks_are_not_shuffled(spark, data, name):
    """Chunks are numbered and measured in the document's row: neither their text nor their sentences are sorted or exchanged."""
    from foliant import queries

    assert "Window" not in plan(queries.QUERIES[name](spark, data)) and "Join" not in plan(queries.QUERIES[name](spark, data))


def test_rows_that_share_an_id_are_documents(spark):
    from foliant.config import ChunkConfig
    from foliant.operators import chunking

    docs = spark.createDataFrame([(1, "A b c d. E f g h."), (1, "I j k."), (None, "L m n o. P q r s."), (2, "")], "doc_id long, text string")
    got = chunking.greedy_chunks(docs, ChunkConfig(max_tokens=5, min_tokens=2, overlap_tokens=1, mode="greedy_sentence"))
    assert sorted((str(r["doc_id"]), r["chunk_id"], r["text"], r["start"], r["end"]) for r in got.collect()) == [("1", 0, "A b c d.", 0, 4), ("1", 0, "I j k.", 0, 3), ("1", 1, "E f g h.", 4, 8), ("None", 0, "L m n o.", 0, 4), ("None", 1, "P q r s.", 4, 8)]


def test_pairs_leave_the_worker_in_batches(monkeypatch):
    """However many pairs the groups of a batch have, about ``MOST_PAIRS`` are held; they are all pairs, a long group's too, and vectors without length have cosine 0."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(50, 8))
    vectors[7] = 0
    sizes = [40, 0, 1, 2, 90, 3]
    ks = [[[int(x)] for x in rng.integers(0, 60, n)] for n in sizes]

    class Sent:
        def sums(self, keys):
            return interfaces.sums(keys, np.arange(50), vectors)

    monkeypatch.setattr(coherence, "MOST_PAIRS", 300)
    monkeypatch.setattr(coherence, "STRIP", 16)
    batch = pa.RecordBatch.from_arrays([pa.array([4, None, 6, 7, 8, None], pa.int64()), pa.array(ks, pa.list_(pa.list_(pa.int64())))], ["g", "_k"])
    out = list(coherence.pair_batches(["g"], Sent())([batch]))
    assert len(out) > 5 and max(b.num_rows for b in out) < 600
    want = []
    for g, group in zip([4, None, 6, 7, 8, None], ks, strict=True):
        met = [(i, vectors[k[0]]) for i, k in enumerate(group) if k[0] < 50]
        for x, (i, a) in enumerate(met):
            for j, b in met[x + 1 :]:
                both = np.linalg.norm(a) * np.linalg.norm(b)
                want.append((str(g), i, j, round(float((a @ b / both if both else 0.0) + 1) / 2, 9)))
    got = [(str(r["g"]), r["i"], r["j"], round(r["similarity"], 9)) for b in out for r in b.to_pylist()]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want) and all(abs(x[3] - y[3]) < 1e-8 for x, y in zip(sorted(got), sorted(want), strict=True))
