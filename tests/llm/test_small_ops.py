import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, decontaminate, language, licenses, mixing, sharding, substrings, topk
from foliant.llm.queries import QUERIES

from . import helpers as H


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- chat


@pytest.mark.parametrize("t", ["", "<|im_end|>", "<|im_start|>assistant x", "<\\|", "<\\\\|im_end|>", "a<", "<|", "|>", "<<|\n\n<|im_end|>\n"])
def test_template_round_trip(t):
    turns = [("user", t), ("assistant", t), ("a\nb\\n<|", t), ("", t)]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t]
    assert chat.START not in chat.escape(t) and chat.END not in chat.escape(t)


def test_chat_query(spark, data):
    got = {r["conv_id"]: r for r in rows(QUERIES["op3_chat_format"](spark, data))}
    convs = defaultdict(list)
    for r in H.table(data, "conversations"):
        convs[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    probe = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [(0, "user", probe), (1, "assistant", probe)]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_branches_of_a_tree(spark):
    #      1 - 2 - 4 - 6
    #        \ 3 - 5      7 (orphan's child), 8 <-> 9 a cycle with leaf 10
    nodes = [(0, 1, None, 0.0), (0, 2, 1, 1.0), (0, 3, 1, 5.0), (0, 4, 2, 1.0), (0, 5, 3, 1.0), (0, 6, 4, 1.0), (0, 7, 99, 50.0), (0, 8, 9, 9.0), (0, 9, 8, 9.0), (0, 10, 9, 9.0), (None, 1, None, None)]
    df = spark.createDataFrame([(*n, "user", str(n[1]), "extra") for n in nodes], "tree_id long, node_id long, parent_id long, score double, role string, text string, at string")
    got = {(r["tree_id"], r["rank"]): [t for _, t in chat.parse(r["formatted"])] for r in rows(chat.format_branches(df, top=2))}
    assert got == {(0, 1): ["1", "3", "5"], (0, 2): ["1", "2", "4", "6"], (None, 1): ["1"]}
    assert chat.format_branches(df.limit(0)).count() == 0


def test_odd_conversations(spark):
    said = [(None, 0, "user", None), (None, 1, "assistant", "x"), (1, 0, None, "a"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, None, "user", ""), (3, 5, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_branches(chat.threads(df))))}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {None: (2, 1), 1: (3, 2), 2: (1, 0), 3: (1, 250_000)}


# --- sharding


def test_sharding_law(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = rows(sharding.shard_documents(docs))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in H.table(data, "documents")}
    by = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text[r["doc_id"]]) + 16, zlib.crc32(text[r["doc_id"]]), "key")
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(40))
    grown = {r["doc_id"]: r["shard"] for r in rows(sharding.shard_documents(docs, 41))}
    assert all(r["grown_shard"] == grown[r["doc_id"]] and r["grown_shard"] in (r["shard"], 40) for r in got)

    def least(doc, n):
        u = [(int(hashlib.md5(f"{doc}/{i}".encode()).hexdigest()[:13], 16), -i) for i in range(n)]
        return -max(u)[1]

    assert all(r["shard"] == least(r["doc_id"], 40) for r in got)


def test_weights_groups_and_odd_rows(spark, monkeypatch):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in rows(sharding.shard_documents(many, 3, [1, 2, 3]).groupBy("shard").count())}
    assert all(abs(n[i] / 6000 - w / 6) < 0.03 for i, w in enumerate((1, 2, 3)))
    monkeypatch.setattr(sharding, "ROWS_PER_GROUP", 50)
    per = defaultdict(list)
    for r in rows(sharding.shard_documents(many, 3)):
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    got = rows(sharding.shard_documents(H.odd(spark)))
    assert len(got) == len(H.ODD) and {r["size"] for r in got if r["doc_id"] == 2} == {16}
    assert sharding.shard_documents(H.empty(spark)).count() == 0


def test_copies_of_one_row_are_counted_first(spark, monkeypatch):
    from foliant.llm import common

    monkeypatch.setattr(sharding, "ROWS_PER_GROUP", 50)
    monkeypatch.setattr(common, "UNFOLD", 70)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("_m"), F.lit(1).alias("slot"))
    out = sharding.shard_documents(docs, 3)
    per = defaultdict(list)
    for r in rows(out):
        per[r["shard"]].append(r["slot"])
    assert sum(map(len, per.values())) == 3000 and all(sorted(v) == list(range(len(v))) for v in per.values())
    sevens = sorted(r["slot"] for r in rows(out.where("doc_id = 7")))
    assert sevens == list(range(sevens[0], sevens[0] + 1001))


@pytest.mark.parametrize("n", [0, 1, 69, 70, 71, 141, 500])
def test_unfold(spark, monkeypatch, n):
    from foliant.llm import common

    monkeypatch.setattr(common, "UNFOLD", 70)
    got = common.unfold(spark.createDataFrame([("a", n), ("b", 2)], "k string, n long"), "n", "i")
    assert sorted((r["k"], r["i"]) for r in rows(got)) == [("a", i) for i in range(n)] + [("b", 0), ("b", 1)]


# --- language


def test_language_held_out(spark, data):
    got = rows(QUERIES["op6_language_id"](spark, data))
    lang = {r["doc_id"]: r["lang"] for r in H.table(data, "documents")}
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = H.odd(spark)
    got = rows(language.identify(odd, docs))
    und = [(r["doc_id"], r["score"]) for r in got if r["lang_pred"] == "und"]
    assert sorted(und) == [(2, 0.0), (3, 0.0), (4, 0.0)] and len(got) == len(H.ODD)
    assert {r["lang_pred"] for r in rows(language.identify(odd, docs.limit(0)))} == {"und"}
    assert language.identify(H.empty(spark), docs).count() == 0
    assert language.keep_identified(H.empty(spark)).count() == 0
    # without a label only letterless rows go
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(str, (r["doc_id"] for r in rows(language.keep_identified(bare))))) == ["1", "1", "5", "6", "7", "None"]


def test_keep_identified_drops_what_no_language_fits(spark):
    train = [(d, "aaa bbb " * 9 if d % 2 else "ccc ddd " * 9, "x" if d % 2 else "y") for d in range(40)]
    docs = spark.createDataFrame([*train, (100, "aaa bbb ccc ddd", None), (101, "aaa", None), (102, "ddd ccc", None), (103, "12", "x"), (None, "bbb", None), (101, "aaa", None)], "doc_id long, text string, lang string").withColumn("a.b", F.lit(1))
    _, matrix = language.train(docs.where(~language.held_out()))
    _, _, p = language.score(["aaa bbb ccc ddd", "aaa", "ddd ccc", "bbb"], matrix)
    assert p[0] < 0.95 < p[1:].min()
    kept = language.keep_identified(docs, least=0.95)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in rows(kept) if r["doc_id"] is None or r["doc_id"] >= 40) == ["101", "101", "102", "None"]


def plain_features(text):
    """The three kinds of n-grams of a text, one by one."""
    low = [0, *(ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""), 0]
    m, top = (1 << 32) - 1, 32 - language.BITS
    out = ([], [], [])
    for i, a in enumerate(low):
        b, before = (low[i + 1] if i + 1 < len(low) else 0), (low[i - 1] if i else 0)
        mixed = a * 0x9E3779B1 & m
        if a:
            out[0].append(mixed >> top)
            out[2].append((((before * 0x27D4EB2F & m ^ mixed) * 0x165667B1 + b * 0xC2B2AE35) * 0x85EBCA6B & m) >> top)
        if a or b:
            out[1].append(((mixed ^ (b * 0x85EBCA77 + 0x7F4A7C15 & m)) * 0xC2B2AE3D & m) >> top)
    return out


def test_scores_match_a_plain_model(spark):
    train = [(0, "abc ab été", "x"), (2, "Zz top! zebra", "y"), (3, "abba cab", "x"), (4, "lazy zoo", "y"), (5, "quick", "z"), (6, None, "x"), (7, "no label", None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    langs, matrix = language.train(df)
    assert langs == ["x", "y", "z"]
    size = 1 << language.BITS
    counts = {g: ([0] * size, [0] * size, [0] * size) for g in langs}
    for _, t, g in train:
        for k, fs in enumerate(plain_features(t) if t and g else ()):
            for f in fs:
                counts[g][k][f] += 1
    texts = ["abc", "zoo lazy", "quick été", "", None, "12", "a", "zebra cab " * 30]
    known, best, p = language.score(texts, matrix)
    for t, k, j, q in zip(texts, known, best, p, strict=True):
        fs = plain_features(t)
        n = sum(map(len, fs))
        assert k == any(c.isalpha() for c in t or "")
        if not k:
            continue
        logs = [sum(np.log((counts[g][i][f] + 0.5) / (sum(counts[g][i]) + 0.5 * size)) for i in range(3) for f in fs[i]) for g in langs]
        assert j == int(np.argmax(logs))
        odds = np.exp((np.array(logs) - max(logs)) * min(1.0, language.EVIDENCE / n))
        assert q == pytest.approx(1 / odds.sum(), rel=1e-4)
    # beyond the bound the most frequent labels are learned
    assert language.train(df, most_languages=2)[0] == ["x", "y"]


# --- decontamination


def brute_windows(docs, items, width=13):
    wins = defaultdict(set)
    for i, t in items:
        w = H.WORD.findall(H.lower(t or ""))
        for k in range(len(w) - width + 1 if len(w) >= width else bool(w)):
            wins[tuple(w[k : k + width])].add(str(i))
    sizes = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w, hit, found = H.WORD.findall(H.lower(t or "")), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, data):
    got = sorted((tuple(r) for r in QUERIES["op7_decontaminate"](spark, data).collect()), key=str)
    assert got == brute_windows([(r["doc_id"], r["text"]) for r in H.table(data, "documents")], [(r["item_id"], r["text"]) for r in H.table(data, "benchmark")])


@pytest.mark.parametrize("limit, size, passes", [(100_000, 64_000_000, 8), (3, 64_000_000, 8), (100_000, 300, 100), (3, 64_000_000, 1)])
def test_decontamination_odd(spark, monkeypatch, limit, size, passes):
    for name, n in (("BROADCAST_WINDOWS", limit), ("BROADCAST_BYTES", size), ("MOST_PASSES", passes)):
        monkeypatch.setattr(decontaminate, name, n)
    items = [(1, "quick brown"), (2, None), (3, ""), (None, "word"), (4, "four FIVE"), (5, "four five"), (6, " ".join(f"w{i}" for i in range(15)))]
    docs = [*((r[0], r[1]) for r in H.ODD), (8, " ".join(f"w{i}" for i in range(14))), (9, "four five four five, word")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("items", F.lit("q"))
    got = sorted((tuple(r) for r in decontaminate.decontamination_report(d, b).drop("spans").collect()), key=str)
    # an item without an id hits words but has no name to list
    assert [g[:3] for g in got] == [w[:3] for w in brute_windows(docs, [("null", t) if i is None else (i, t) for i, t in items])]
    assert decontaminate.decontamination_report(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontamination_report(H.empty(spark), b).count() == 0
    bad = [r["doc_id"] for r in rows(decontaminate.decontamination_report(d, b)) if r["contaminated"]]
    kept = [r["doc_id"] for r in rows(decontaminate.remove_contaminated(d, b))]
    assert sorted(map(str, [*bad, *kept])) == sorted(str(x) for x, _ in docs)
    assert decontaminate.remove_contaminated(H.empty(spark), b).count() == 0 and decontaminate.mask_spans(H.empty(spark), b).count() == 0
    masked = {r["doc_id"]: r["words"] for r in rows(decontaminate.mask_spans(d, b))}
    assert masked[9] == [] and masked[3] == []


# --- licences


@pytest.mark.parametrize(
    "text, labels, fine",
    [("MIT", {"mit"}, True), ("GPL-2.0 OR MIT", {"gpl-2.0", "mit"}, True), ("GPL-2.0 AND MIT", {"gpl-2.0", "mit"}, False), ("GPL-2.0 WITH X-exception", {"gpl-2.0 with x-exception"}, False), ("(MIT OR GPL-2.0) AND ISC", {"mit", "gpl-2.0", "isc"}, True), ("mit or gpl-2.0 and x", {"mit", "gpl-2.0", "x"}, True), ("MIT */", {"mit"}, True)],
)
def test_expressions(text, labels, fine):
    assert licenses.evaluate(licenses.rpn(text)) == (labels, fine)


@pytest.mark.parametrize("text", ["", "OR MIT", "MIT OR", "(MIT", "()", "AND"])
def test_malformed_expressions(text):
    assert licenses.rpn(text) is None


@pytest.mark.parametrize("text, want", [("MIT OR", {"mit"}), ("(MIT", {"mit"}), ("OR MIT", {"mit"}), ("MIT AND (GPL-2.0 OR", {"mit", "gpl-2.0"}), ("MIT license text", {"mit"}), ("", set()), ("()", set())])
def test_identifiers_of_malformed_expressions(text, want):
    assert licenses.identifiers(text) == want


def brute_base(text):
    w = H.WORD.findall(H.lower(text or ""))
    places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_query(spark, data):
    text = {r["doc_id"]: r["text"] for r in H.table(data, "documents")}
    for r in rows(QUERIES["op8_license_scan"](spark, data)):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_license_odd(spark):
    docs = [(1, None), (2, ""), (3, "CC BY cc-by cc by"), (4, "cc bye"), (5, "All rights\nreserved. SPDX-License-Identifier: (MIT OR GPL-2.0)\nx"), (None, "GNU General Public License"), (6, "CC BY-NC 4.0"), (7, "SPDX-License-Identifier: MIT OR\nx"), (8, "word " * 60_000 + "all rights reserved"), (8, "word " * 60_000 + "all rights reserved")]
    got = {r["doc_id"]: r for r in rows(licenses.license_report(spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1))))}
    for d, t in docs:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t)
    assert (got[7]["labels"], got[7]["tags_permissive"]) == ("mit", None) and got[1]["tags_permissive"] is None
    assert got[5]["labels"] == "gpl-2.0,mit,reserved" and got[5]["tags_permissive"] and got[6]["labels"] == "cc-by,cc-by-nc"
    assert licenses.license_report(H.empty(spark)).count() == 0


# --- mixing


def brute_targets(size, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    left, act, out = share * sum(size.values()), set(names), {}
    while act:
        total = sum(w[n] for n in act)
        over = [n for n in act if left * w[n] / total > cap * size[n]]
        if not over:
            return out | {n: left * w[n] / total for n in act}
        for n in over:
            out[n] = cap * size[n]
        left -= sum(out[n] for n in over)
        act -= set(over)
    return out


def test_mix(spark, data):
    docs = H.table(data, "documents")
    size = {r["doc_id"]: len(H.SPACED.findall(r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    per = defaultdict(int)
    for d, n in size.items():
        per[source[d]] += n
    want = brute_targets(per)
    df = QUERIES["op9_mix_sources"](spark, data)
    got = rows(df)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
        taken[source[r["doc_id"]]] += r["taken"]
    most = {s: max(n for d, n in size.items() if source[d] == s) for s in want}  # a handful of texts a source
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    assert sorted(map(str, got)) == sorted(map(str, rows(QUERIES["op9_mix_sources"](spark, data))))


def plain_fold(items):
    """The pivotal method over items in order: which places win, and the one left with its probability."""
    c, x, won = 0, items[0]["p"], set()
    for i in range(1, len(items)):
        y, r = items[i]["p"], items[i]["size"] / items[c]["size"]
        up, down = min(1 - x, y * r), min(x, (1 - y) * r)  # what c can gain from i, and lose to it
        if items[i]["u"] * (up + down) < down:  # c gains, the rarer the more it could lose
            if 1 - x <= y * r:
                won.add(c)
                c, x = i, max(0.0, y - (1 - x) / r)
            else:
                x += y * r
        elif x <= (1 - y) * r:
            c, x = i, min(1.0, y + x / r)
        else:
            won.add(i)
            x -= (1 - y) * r
    return won, c, x


def test_rounding_equals_a_plain_fold(spark):
    rng = np.random.default_rng(12)
    level = [(f"s{i % 3}", i % 2, int(rng.integers(1, 90)), int(rng.integers(-(1 << 62), 1 << 62)), i, i * 17, 1, float(rng.uniform(0.01, 0.99))) for i in range(300)]
    df = spark.createDataFrame(level, "source string, k int, size long, h long, doc_id long, text_hash long, m long, p double")
    out = rows(mixing._round(df, ["source", "k"], 3))
    drawn = {r["doc_id"]: r["u"] for r in rows(df.selectExpr("doc_id", f"{mixing._U.format('h, doc_id, text_hash, 3')} as u"))}
    assert len(out) == 6
    for r in out:
        own = sorted(({"size": x[2], "h": x[3], "doc_id": x[4], "p": x[7], "u": drawn[x[4]]} for x in level if (x[0], x[1]) == (r["source"], r["k"])), key=lambda z: (z["size"], z["h"], z["doc_id"]), reverse=True)
        won, c, x = plain_fold(own)
        assert {d["doc_id"] for d in r["done"] if d["win"]} == {own[i]["doc_id"] for i in won} and len(r["done"]) == len(own) - 1
        assert r["rest"]["doc_id"] == own[c]["doc_id"] and r["rest"]["p"] == pytest.approx(x, abs=1e-9)
        words = sum(own[i]["size"] for i in won) + x * own[c]["size"]
        assert words == pytest.approx(sum(z["p"] * z["size"] for z in own))  # what is decided and what is left are the words asked for


def test_mix_probabilities_hold(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.expr("repeat('x ', int(id % 40))")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    got = mixing.mix_documents(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.avg(F.col("taken") / F.col("size")).alias("copies"), (F.first("target") / F.first("source_size")).alias("ratio"))
    for r in rows(got):
        assert abs(r["t"] - r["want"]) <= 0.002 * r["want"] + 5 and abs(r["copies"] - r["ratio"]) < 0.05


def test_mix_odd_rows(spark):
    got = rows(mixing.mix_documents(H.odd(spark)))
    assert len(got) == len(H.ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_documents(H.empty(spark)).count() == 0
    hot = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text here").alias("text"), F.lit("s").alias("source")).union(spark.createDataFrame([(2, "a b c d", "t")], "doc_id long, text string, source string"))
    got = rows(mixing.mix_documents(hot))
    assert len(got) == 501 and abs(sum(r["taken"] for r in got if r["doc_id"] == 1) - [r["target"] for r in got if r["doc_id"] == 1][0]) <= 3
    out = mixing.apply_mix(hot.withColumn("extra", F.lit(1)))
    assert out.columns == ["doc_id", "text", "source", "extra"] and abs(out.where("doc_id = 1").count() * 3 - sum(r["taken"] for r in got if r["doc_id"] == 1)) <= 3


# --- substrings


def brute_substrings(docs, least=substrings.LEAST_WORDS):
    first, out = {}, {}
    order = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    for d, t in order:
        for u, x in enumerate(substrings.units(t)):
            first.setdefault(x[3], (d, t, u))
    for d, t in docs:
        own = substrings.units(t or "")
        rep = {u for u, x in enumerate(own) if first[x[3]] != (d, t, u)}
        spans, u = [], 0
        while u < len(own):
            v = u
            while v < len(own) and v in rep:
                v += 1
            if v > u and sum(x[2] for x in own[u:v]) >= least:
                spans.append((own[u][0], own[v - 1][1]))
            u = max(v, u + 1)
        left, at = "", 0
        for a, b in spans:
            left, at = left + t[at:a], b
        out[d, t] = (len(own), spans, None if t is None else left + t[at:])
    return out


def test_substrings_hold_what_units_alone_find(spark, data):
    docs = {r["doc_id"]: r["text"] for r in H.table(data, "documents")}
    want = {d: x for (d, _), x in brute_substrings(list(docs.items())).items()}
    for r in rows(QUERIES["op2_substring_dedup"](spark, data)):
        n, spans, _ = want[r["doc_id"]]
        got = covered_words(r, docs[r["doc_id"]])
        assert r["n_units"] == n
        assert all(c for c, (_, a, b) in zip(got, plain_words(docs[r["doc_id"]] or "")) if any(s <= a and b <= e for s, e in spans))


def test_units_of_long_runs_of_marks():
    import time

    began = time.perf_counter()
    for t in ("." * 200_000 + "x", "a! " + "?!." * 70_000 + "\n", ("." * 50 + "x ") * 4000):
        assert substrings.units(t) is not None and substrings.parts(t) is not None
    assert time.perf_counter() - began < 2
    assert [t[a:b] for t in ["One two.Three. Four!?\n\nfive...six... \u0085seven"] for a, b in substrings._pieces(t)] == ["One two.Three.", " Four!?", "five...six...", " \u0085seven"]


def test_repeated_passage_goes_once(spark):
    passage = " ".join(" ".join(f"p{k}" for k in range(i, i + 12)) + "." for i in range(0, 60, 12))
    docs = [(1, f"First own words. {passage} End."), (2, f"Other. {passage}\nMore of it."), (3, f"{passage}"), (4, "Nothing. Is. Shared. Here."), (5, "Nothing. Is. Else.")]
    got = {r["doc_id"]: r for r in rows(substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got[1]["n_removed"] == 0 and passage not in got[2]["text"] and got[2]["text"] == "Other. \nMore of it." and got[3]["text"] == ""
    assert got[4]["n_removed"] == got[5]["n_removed"] == 0
    assert docs[1][1][got[2]["removed"][0]["start"] : got[2]["removed"][0]["end"]] == passage


def test_cut_by_batch_is_the_plain_cut():
    rnd = random.Random(5)
    signs = ["a", "B", "\u00e9", " ", "  ", "\n", ".", "!", "?", "*", "#", "\u00a0", "\u3000", "\u0085", "\x1c", "7", "\u65e5", "\U0001f600", "\t", "-"]
    for _ in range(600):
        width, texts, us = rnd.choice([1, 2, 3, 5]), [], []
        for _ in range(rnd.randint(0, 6)):
            t = None if rnd.random() < 0.1 else "".join(rnd.choice(signs) if rnd.random() < 0.6 else "w " for _ in range(rnd.randint(0, 60)))
            n = len(plain_words(t or ""))
            u = [x[1] * 4 + x[0] for x in substrings.parts(t or "") if rnd.random() < 0.4] + [k * 4 + substrings.WINDOW for k in range(n - width + 1) if rnd.random() < 0.1]
            u += [((rnd.randint(width, n - k) << 31) + k) * 4 + substrings.CHUNKED for k in range(n - width + 1) if rnd.random() < 0.05]
            texts.append(t)
            us.append(u or None)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array(us, pa.list_(pa.int64()))], ["doc_id", "text", "us"])
        got = [r for b in substrings._cut(width)([batch]) for r in b.to_pylist()]
        assert len(got) == len(texts)
        for t, u, r in zip(texts, us, got):
            n, spans, left = substrings.cut(t or "", set(u or ()), width)
            assert (r["n_units"], [(x["start"], x["end"]) for x in r["removed"]], r["text"]) == (n, spans, None if t is None else left)
            assert (r["n_removed"], r["removed_chars"]) == (len(spans), sum(b - a for a, b in spans))


def test_substrings_odd_rows(spark):
    got = rows(substrings.dedup_substrings(H.odd(spark), least_words=3))
    assert len(got) == len(H.ODD) and [r["text"] for r in got if r["doc_id"] == 2] == [None]
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [1] and [r["n_removed"] for r in got if r["doc_id"] == 1] == [0, 0]
    assert substrings.dedup_substrings(H.empty(spark)).count() == 0


def plain_words(t):
    return [(m[0].translate({c: c + 32 for c in range(65, 91)}), *m.span()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]


def brute_cover(docs, least=substrings.LEAST_WORDS):
    """Of each text the words that repeated windows, runs of repeated units and repeated short lines cover, without hashes."""
    order, met = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0)), set()
    out = {}
    for d, t in order:
        w, own, own_units = [x[0] for x in plain_words(t)], [False] * len(plain_words(t)), []
        at = 0
        for line in t.split("\n"):
            n = len(plain_words(line))
            ends = [u[2] for u in substrings.units(line)]
            places = [(at + sum(ends[:i]), at + sum(ends[: i + 1])) for i in range(len(ends))]
            keys = []
            for a, b in places + [(at, at + n)] * (len(ends) > 1):
                key = ("piece", *w[a:b])
                keys.append(key in met)
                met.add(key)
            own_units += [(a, b, k) for (a, b), k in zip(places, keys)]
            if n >= 3 and keys[-1]:
                own[at : at + n] = [True] * n
            at += n
        for a in range(len(w) - least + 1):
            key = ("window", *w[a : a + least])
            if key in met:
                own[a : a + least] = [True] * least
            met.add(key)
        run = []
        for a, b, k in [*own_units, (0, 0, False)]:
            if k:
                run.append((a, b))
            else:
                if run and run[-1][1] - run[0][0] >= least:
                    own[run[0][0] : run[-1][1]] = [True] * (run[-1][1] - run[0][0])
                run = []
        out[d, t] = own
    return out


def covered_words(r, t):
    return [any(s["start"] <= a and b <= s["end"] for s in r["removed"]) for _, a, b in plain_words(t)]


def test_substrings_are_whole(spark, data):
    docs = {r["doc_id"]: r["text"] for r in H.table(data, "documents")}
    want = brute_cover(list(docs.items()))
    for r in rows(QUERIES["op2_substring_dedup"](spark, data)):
        t = docs[r["doc_id"]]
        assert covered_words(r, t) == want[r["doc_id"], t], r["doc_id"]
        left = "".join(c for i, c in enumerate(t) if not any(s["start"] <= i < s["end"] for s in r["removed"]))
        assert r["text"] == left and r["n_removed"] == len(r["removed"]) and r["removed_chars"] == len(t) - len(left)


def test_hot_digests_are_dealt(spark, monkeypatch):
    for name, n in (("SAMPLE", 1), ("HOT", 3), ("SALTS", 4)):
        monkeypatch.setattr(substrings, name, n)
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 60, 14)) + "." for _ in range(6)]
    docs = [(int(d), "\n".join([*(lines[k] for k in rng.integers(0, 6, 3)), f"own {d} text."])) for d in range(60)]
    want = brute_cover(docs)
    got = rows(substrings.dedup_substrings(spark.createDataFrame(docs * 2, "doc_id long, text string")))
    assert len(got) == 120 and all(covered_words(r, dict(docs)[r["doc_id"]]) == want[r["doc_id"], dict(docs)[r["doc_id"]]] for r in got)


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return t


def test_run_digests_tell_long_runs_apart():
    from foliant.llm import hashing

    for n in (1024, 4096):
        t = np.array(thue_morse(n))
        h = np.array([11, 29], np.uint64)[np.concatenate([t, 1 - t, t])]
        d = list(zip(*hashing.run_digests(h, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])), strict=True))
        assert d[0] == d[2] and d[0][0] != d[1][0] and d[0][1] != d[1][1]


def test_passages_inside_units(spark):
    p = [f"w{k}" for k in range(40)]
    docs = [
        (1, "At the start " + " ".join(p) + " and more of it"),
        (2, "Mid Sentence é, " + " ".join(p).upper() + " goes on. End"),
        (3, "no marks " + " ".join(p[5:30]) + " here"),
        (4, "symbols " + " ".join(x + ("***" if k % 2 else ".%%%") for k, x in enumerate(p)) + " after"),
        (5, "split " + " ".join(p[:7]) + "\n" + " ".join(p[7:14]) + " over lines"),
        (6, "too short " + " ".join(p[:11]) + " of it"),
        (7, "changed " + " ".join(p[:18] + ["other"] + p[19:]) + " word"),
    ]
    got = {r["doc_id"]: r["text"] for r in rows(substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == {1: docs[0][1], 2: "Mid Sentence é,  goes on. End", 3: "no marks  here", 4: "symbols  after", 5: "split  over lines", 6: docs[5][1], 7: "changed  other  word"}


def test_passage_repeats_within_a_text(spark):
    p = " ".join(f"w{k}" for k in range(15))
    got = rows(substrings.dedup_substrings(spark.createDataFrame([(1, f"a {p} b {p} c")], "doc_id long, text string")))
    assert got[0]["text"] == f"a {p} b  c"


def test_short_lines_go(spark):
    line = "The and attion. Eriner thanea."
    docs = [(d, f"Own text {d} of document\n{line}\nlast {d} x\nOk then") for d in range(50)]
    got = {r["doc_id"]: r["text"] for r in rows(substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == {d: t if d == 0 else t.replace(line, "") for d, t in docs}


# --- top-k


def brute_top(vecs, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in vecs if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            s = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_k(spark, data, monkeypatch):
    want = brute_top([(r["vec_id"], r["embedding"]) for r in H.table(data, "embeddings")])
    assert sorted(tuple(r) for r in QUERIES["op10_top_k"](spark, data).collect()) == want
    for name, n in (("BLOCK", 16), ("BLOCKS", 3), ("QUERIES", 4)):
        monkeypatch.setattr(topk, name, n)
    assert sorted(tuple(r) for r in topk.top_k(spark.read.parquet(f"{data}/embeddings.parquet"), every=25).collect()) == brute_top([(r["vec_id"], r["embedding"]) for r in H.table(data, "embeddings")], every=25)


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 0.0]), (None, [1.0, 1.0]), (8, []), (50, [1.0, 2.0, 3.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("dim", F.lit(9))
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute_top([v for k, v in enumerate(vecs) if k != 1])
    assert topk.top_k(df.limit(0)).count() == 0


def test_pruning_skips_blocks():
    near, far = np.full((8, 4), 100), np.full((8, 4), -100)
    blocks = [(np.arange(8), near, near.max(0), near.min(0)), (np.arange(8, 16), far, far.max(0), far.min(0))]
    top, ids, scored = topk.search_block(np.full((1, 4), 10), np.array([99]), blocks, 5)
    assert scored == 1 and ids[0].tolist() == [0, 1, 2, 3, 4] and re.fullmatch(r"4000", str(top[0, 0]))
    # a k-th score from elsewhere rules out blocks before any is scored
    assert topk.search_block(np.full((1, 4), 10), np.array([99]), blocks, 5, np.array([4001]))[2] == 0
    assert topk.search_block(np.full((1, 4), 10), np.array([99]), blocks, 5, np.array([4000]))[2] == 1


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q = rng.integers(-300, 300, (20, 16))
    blocks = [(np.arange(9), b, b.max(0), b.min(0)) for b in (rng.integers(-300, 300, (9, 16)) * s for s in (1, 0, 5))]
    for j, b in enumerate(blocks):
        assert ((q @ b[1].T).max(axis=1) <= topk.bounds(q, blocks)[:, j]).all()


def test_scores_carry_from_group_to_group(spark, monkeypatch):
    for name, n in (("BLOCK", 8), ("BLOCKS", 2), ("QUERIES", 4), ("HOMES", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(9)
    # long vectors stand in few blocks, so that most blocks fall below the scores found there
    vecs = [(i, (rng.normal(size=6) * (30 if i // 16 % 7 == 0 else 0.1)).tolist()) for i in range(400)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, every=20).collect()) == brute_top(vecs, every=20)
    share = topk.scored_share(df, every=20).first()
    assert share["held"] >= 20 * 50 and share["scored"] < 0.5 * share["held"]


def test_long_and_large_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "COMPONENTS", 64)
    rng = np.random.default_rng(5)
    vecs = [(i, rng.normal(size=40).tolist()) for i in range(60)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute_top(vecs)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df.union(spark.createDataFrame([(99, [1e9] * 40)], "vec_id long, embedding array<double>"))).collect()
