import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.config import ChunkConfig, ReduceConfig
from foliant.functions import text as T
from foliant.functions import tokens as K
from foliant.functions.interfaces import HashedVectors, LeadGenerator, PunctuationSplitter, WhitespaceTokenizer
from foliant.operators import chunking, reduce, validate


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, *values):
    return [r[0] for r in docs(spark, *values).orderBy("doc_id").select(column(F.col("text"))).collect()]


def test_cleaning(spark):
    got = one(spark, T.clean_text, "a Enlarge this IMAGE\nx AP b", "toggle caption q ap c", "toggle caption\nap", "[x\ry] z", "a  b\n\n\nc ", None)
    assert got == ["a b", "c", "toggle caption\nap", "z", "a b\n\nc", None]


def test_splits(spark):
    assert one(spark, T.split_articles, "a|||b", "|||", "a ||||| b", "x") == [["a", "b"], ["|||"], ["a", "|| b"], ["x"]]
    assert one(spark, T.split_paragraphs, "a\n\n b", "\n\n", "x\ny") == [["a", "b"], [""], ["x\ny"]]
    assert one(spark, T.split_sentences, "One. Two!  Three? 3.5 four", "", None) == [["One.", "Two!", "Three?", "3.5 four"], [], None]


def test_truncation_and_blank(spark):
    assert one(spark, lambda c: T.truncate_chars(c, 2), "abc", None) == ["ab", ""]
    assert one(spark, lambda c: K.truncate_tokens(c, 2, 4), "abc def ghi") == ["abc "]
    assert one(spark, lambda c: T.or_placeholder(c, "summary"), " ", None, "x") == ["Empty summary", "Empty summary", "x"]
    assert one(spark, lambda c: K.token_count(c, 1), " a b\n", "", None) == [3, 1, 1]


@pytest.mark.parametrize("n, size, overlap, want", [(0, 4, 1, []), (3, 4, 1, [3]), (4, 4, 1, [4]), (5, 4, 1, [4, 2]), (7, 4, 1, [4, 4]), (9, 4, 0, [4, 4, 1]), (8, 4, 0, [4, 4]), (1, 4, 3, [1])])
def test_flat_windows(spark, n, size, overlap, want):
    d = docs(spark, " ".join(f"t{i}" for i in range(n)))
    got = chunking.flat_chunks(d, size, overlap).orderBy("chunk_id").collect()
    assert [r["token_count"] for r in got] == want
    if got:
        assert got[0]["text"].split()[0] == "t0" and got[-1]["text"].split()[-1] == f"t{n - 1}"


def sentence(n, tag):
    return " ".join([tag] * (n - 1) + [tag + "."])


def test_greedy_rules(spark):
    cfg = ChunkConfig(max_tokens=10, min_tokens=4, overlap_tokens=2, mode="greedy_sentence")
    text = " ".join(sentence(n, f"s{i}") for i, n in enumerate((3, 9, 2, 9, 12, 3)))
    got = [r["token_count"] for r in chunking.greedy_chunks(docs(spark, text), cfg).orderBy("chunk_id").collect()]
    # the first chunk may close below the minimum; 9 + 2 is over, so 9 closes; 2 is under the minimum and grows past the budget
    assert got == [3, 9, 11, 12, 3]
    long_first = [r["token_count"] for r in chunking.greedy_chunks(docs(spark, sentence(20, "a") + " " + sentence(3, "b")), cfg).orderBy("chunk_id").collect()]
    assert long_first == [20, 3]


def expressions_and_machine_agree(spark, texts, cfg):
    d = docs(spark, *texts)
    cols = ["doc_id", "chunk_id", "article", "text", "token_count", "sentence_count", "has_overlap", "overlap_tokens"]
    a = sorted(tuple(r) for r in chunking.overlap_chunks(d, cfg).select(cols).collect())
    b = sorted(tuple(r) for r in chunking.semantic_chunks(d, None, cfg).select(cols).collect())
    assert a == b
    return a


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(st.integers(1, 14), min_size=1, max_size=9), min_size=1, max_size=3), min_size=1, max_size=6), st.sampled_from(["fixed_overlap", "no_overlap"]))
def test_two_implementations_of_overlap(spark, shape, mode):
    texts = ["|||".join(" ".join(sentence(n, f"w{a}x{i}") for i, n in enumerate(art)) for a, art in enumerate(doc)) for doc in shape]
    rows = expressions_and_machine_agree(spark, texts, ChunkConfig(max_tokens=12, min_tokens=3, overlap_tokens=4, mode=mode))
    for d, text in enumerate(texts):
        own = [r for r in rows if r[0] == d]
        assert [r[1] for r in own] == list(range(len(own)))
        fresh = []
        for r in own:
            words = r[3].split()
            fresh += words[r[7] :]
        assert fresh == text.replace("|||", " ").split()  # what is not overlap is the document, in order


def test_tail_rules():
    cfg = ChunkConfig(max_tokens=100, min_tokens=1, overlap_tokens=10, mode="fixed_overlap")
    assert chunking.tail([50, 3, 3, 3], None, cfg) == 3
    assert chunking.tail([3, 8], None, cfg) == 1
    assert chunking.tail([40], None, cfg) == 1
    assert chunking.tail([9, 7], None, cfg) == 1
    assert chunking.tail([5, 5], None, cfg.with_mode("no_overlap")) == 1


def test_smoothing_and_split():
    v = np.array([1.0, 0.0, 1.0, 0.0, 1.0, 1.0])
    s = chunking.smooth(v)
    assert len(s) == 6 and abs(chunking.smooth(np.ones(9)) - 1).max() < 1e-9 and (chunking.smooth(v[:4]) == v[:4]).all()
    cfg = ChunkConfig(max_tokens=100, min_tokens=1, overlap_tokens=1, semantic_weight=1.0)
    e = np.eye(2)
    vec = np.array([e[0], e[0], e[0], e[0], e[1], e[1], e[1], e[1]])
    assert chunking.split_point([5] * 8, vec, [set()] * 8, cfg) == 4
    assert chunking.split_point([5] * 2, vec[:2], [set()] * 2, cfg) == 2
    assert chunking.split_point([5] * 8, vec, [set()] * 8, ChunkConfig(max_tokens=100, min_tokens=90, overlap_tokens=1)) == 8


def test_semantic_chunks_keep_order(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    enc = HashedVectors(spark.read.parquet(f"{data}/embeddings.parquet"))
    cfg = ChunkConfig(max_tokens=128, min_tokens=32, overlap_tokens=16)
    got = chunking.semantic_chunks(d, enc, cfg).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in d.select("doc_id").collect()}
    assert all(-1e-9 <= r["coherence"]["local"] <= 1 + 1e-9 and (r["coherence"]["hierarchical"] is None) == (r["sentence_count"] <= 10) for r in got)
    words = {r["doc_id"]: " ".join(r["w"]) for r in d.select("doc_id", K.tokens(T.clean_text(F.col("text"))).alias("w")).collect()}
    for r in got:
        own = words[r["doc_id"]].split()
        assert own[r["start"] : r["end"]] == r["text"].split() and " ".join(r["sentences"]) == r["text"]


def test_config_round_trip():
    c = ChunkConfig(mode="large_overlap")
    assert ChunkConfig.from_json(c.to_json()) == c and c.target == 64 and c.digest == ChunkConfig.from_json(c.to_json()).digest
    for bad in ({"overlap_tokens": 256}, {"min_tokens": 300}, {"mode": "x"}):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)


def test_reduction_layers(spark):
    cfg = ReduceConfig(chunk=ChunkConfig(max_tokens=40, min_tokens=1, overlap_tokens=1, mode="greedy_sentence"), budget=60, map_short=20, map_long=20, group_len=15, final_len=30, enough=40)
    many = " ".join(sentence(20, f"s{i}") for i in range(40))
    got = {r["doc_id"]: r for r in reduce.summarize(docs(spark, many, "", "Just one. Two.", None), cfg=cfg).collect()}
    assert got[0]["reduction_layers"] >= 2 and 0 < got[0]["final_tokens"] <= 40 and got[0]["n_chunks"] == 20
    assert (got[1]["n_chunks"], got[1]["final_summary"], got[1]["reduction_layers"]) == (0, "", 0) and got[3]["n_chunks"] == 0
    assert got[2]["final_summary"] == "Just one. Two." and got[2]["reduction_layers"] == 0


def test_reduction_by_a_udf_is_the_same(spark, data):
    import pandas as pd

    from foliant.functions.interfaces import UdfGenerator
    from foliant.plans.experiments import clusters

    @F.pandas_udf("string")
    def lead(t: pd.Series, n: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([" ".join((x or "").split()[:1024][:k]) for x, k in zip(t, n, strict=True)])

    c = clusters(spark.read.parquet(f"{data}/documents.parquet"))
    cfg = ReduceConfig(chunk=ChunkConfig(max_tokens=64, min_tokens=16, overlap_tokens=8, mode="greedy_sentence"), budget=300)
    want = sorted(tuple(r) for r in reduce.summarize(c, cfg=cfg).collect())
    assert sorted(tuple(r) for r in reduce.summarize(c, UdfGenerator(lead), cfg).collect()) == want
    assert max(r[2] for r in want) >= 2


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 1500), min_size=1, max_size=20))
def test_bin_pack(spark, costs):
    starts = reduce.bin_pack(spark.createDataFrame([(costs,)], "c array<int>"), "c").first()["starts"]
    groups = [costs[a:b] for a, b in zip(starts, [*starts[1:], len(costs)], strict=True)]
    assert sum(groups, []) == costs and all(sum(g) <= 1000 or len(g) == 1 for g in groups)
    assert all(sum(g) + h[0] > 1000 for g, h in zip(groups, groups[1:], strict=False))


def test_validation(spark):
    c = spark.createDataFrame([(0, 0, "a b", 300, 0, ["a", "b"], 0.9), (0, 1, "a b", 2, 0, ["a", "c"], 0.1), (0, 2, "a b", 2, 2, ["a", "b"], 1.0)], "doc_id long, chunk_id int, text string, token_count int, overlap_tokens int, sentences array<string>, coherence double")
    got = {r["chunk_id"]: (r["is_valid"], r["warnings"]) for r in validate.validate(c, ChunkConfig(max_tokens=256, min_tokens=64, overlap_tokens=8)).collect()}
    assert got == {0: (False, "over budget; count mismatch"), 1: (True, "under minimum; not reconstructible; low coherence"), 2: (True, "excessive overlap")}
    assert validate.longest_common_run(list("abcde"), list("xbcdy")) == 3 and validate.longest_common_run(list("bcdxx"), list("xxbcd")) == 2


def test_stats_of_no_chunks(spark):
    d = docs(spark, "", "One two.")
    got = {r["doc_id"]: r["num_chunks"] for r in validate.chunk_stats(chunking.overlap_chunks(d), d).collect()}
    assert got == {0: 0, 1: 1}


def test_defaults_fit_the_interfaces(spark):
    assert one(spark, lambda c: LeadGenerator().generate(c, 2), "a b c") == ["a b"]
    assert one(spark, PunctuationSplitter().sentences, "A. B.") == [["A.", "B."]] and one(spark, WhitespaceTokenizer().tokens, "a b") == [["a", "b"]]
