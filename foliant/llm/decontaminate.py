"""Benchmark decontamination: a hash set of benchmark word windows scanned over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, table, unfold, words, wrapped

#: Words of a window.
WINDOW = 13
#: So many distinct windows, of so many bytes of words and items, are broadcast at once; a larger set is dealt by hash over as many passes over the documents.
BROADCAST_WINDOWS, BROADCAST_BYTES = 100_000, 64_000_000
#: Beyond so many passes documents' windows meet the benchmark's by digest in a shuffle instead.
MOST_PASSES = 8
#: Stands for the document itself in the stream of its words; no word holds this character.
MARK = "\u0000"


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: ``window`` (words), ``anchor`` (the window's word that fewest windows hold) with its place ``at``, and ``items``."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(ascii_lower(F.col("text")), NON_WORD).alias("w")).where(F.size("w") > 0)
    cut = item.select("item", F.explode(F.expr(f"if(size(w) >= {width}, transform(sequence(0, size(w) - {width}), i -> slice(w, i + 1, {width})), array(w))")).alias("window"))
    win = cut.groupBy("window").agg(F.collect_set("item").alias("items"))
    word = win.select("window", F.posexplode("window").alias("at", "anchor"))
    often = word.groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("n"))
    best = word.join(often, F.col("anchor") == F.col("_a")).groupBy("window").agg(F.min(F.struct("n", (-F.length("anchor")).alias("l"), "at", "anchor")).alias("b"))
    return win.join(best, "window").select("window", "items", F.col("b.at").alias("at"), F.col("b.anchor").alias("anchor"))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Benchmark words found in documents: ``doc_id, text_hash, m, n_words, spans, items``, a row for each distinct (doc_id, text).

    Document words stream past the set of anchor words; where one matches, the whole window is compared, so that a hit is exact.
    ``spans`` are the (start, end) word ranges of all occurrences, ``items`` the benchmark items they belong to, ``m`` the number
    of equal rows. A document without hits has empty arrays.
    """
    win = table(benchmark_windows(benchmark, width), "windows")
    size = win.agg(F.count("*").alias("n"), F.sum(F.expr("octet_length(array_join(window, '  ')) + 16 * size(window) + octet_length(array_join(items, '  ')) + 16 * size(items) + 64")).alias("bytes")).first()
    doc = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(ascii_lower(F.col("text")), NON_WORD).alias("w"))
    passes = max(1, -(-size["n"] // BROADCAST_WINDOWS), -(-(size["bytes"] or 0) // BROADCAST_BYTES))
    hit = _by_anchor(doc, win, passes) if passes <= MOST_PASSES else _by_digest(doc, win)
    return (
        hit.groupBy("doc_id", "text_hash")
        .agg(F.count(F.when(F.col("n").isNotNull(), 1)).alias("m"), F.max("n").cast("bigint").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )


def _by_anchor(doc: DataFrame, win: DataFrame, passes: int) -> DataFrame:
    """``doc_id, text_hash, n, items, span``: a row for each document (with ``n``) and each hit. Every word meets the broadcast anchors; a meeting is verified in the row, which has all words."""
    mark = doc.sparkSession.range(1).select(F.array(F.lit(MARK)).alias("window"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).alias("at"), F.lit(MARK).alias("anchor"))
    word = doc.withColumn("w", F.concat(F.array(F.lit(MARK)), F.col("w"))).select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "word"))
    hit = None
    for i in range(passes):
        part = win if passes == 1 else win.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == i)
        met = word.join(F.broadcast(part if i else part.unionByName(mark)), F.col("word") == F.col("anchor")).where("pos >= at and slice(w, pos - at + 1, size(window)) = window")
        hit = met if hit is None else hit.unionByName(met)
    return hit.select("doc_id", "text_hash", F.expr("if(items is null, size(w) - 1, null)").alias("n"), "items", F.expr("if(items is null, null, named_struct('s', pos - at - 1, 'e', pos - at - 1 + size(window)))").alias("span"))


def _by_digest(doc: DataFrame, win: DataFrame) -> DataFrame:
    """The same for benchmarks too large to broadcast: 128-bit digests of all the documents' windows meet those of the benchmark's in a shuffle.

    Windows of a document that stand more than once go as one row. The digest is the verification: equal ones are taken for equal windows.
    """
    lengths = [r["n"] for r in win.select(F.size("window").alias("n")).distinct().collect()]  # WINDOW values at most
    digest = lambda w: F.md5(F.to_json(w))  # noqa: E731  quoted, so that it tells where words end
    cut = F.concat(*[F.expr(f"if(size(w) >= {n}, transform(sequence(1, size(w) - {n} + 1), i -> named_struct('s', i - 1, 'g', slice(w, i, {n}))), array())") for n in lengths]) if lengths else None
    own = doc.select("doc_id", "text_hash", F.size("w").alias("n"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("struct<s: int, e: int>").alias("span"))
    if cut is None:
        return own
    each = doc.select("doc_id", "text_hash", F.explode(cut).alias("x")).select("doc_id", "text_hash", digest(F.col("x.g")).alias("k"), F.struct(F.col("x.s").alias("s"), (F.col("x.s") + F.size("x.g")).alias("e")).alias("span"))
    met = each.join(win.select(digest(F.col("window")).alias("_k"), "items"), F.col("k") == F.col("_k"))
    return own.unionByName(met.select("doc_id", "text_hash", F.lit(None).cast("int").alias("n"), "items", "span"))


def covered(spans) -> F.Column:
    """How many words the sorted (start, end) ranges cover."""
    step = f"(a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(a.t, x.s)), 't', greatest(a.t, x.e))"
    return F.expr(f"aggregate({spans}, named_struct('n', 0, 't', 0), {step}).n").cast("bigint")


def judge(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    found = scan(docs, benchmark, width).withColumn("n_hit", covered("spans"))
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each row of ``docs``.

    Null text and null items have no words; items below ``width`` words are one window; equal rows each get their row; with an empty
    benchmark nothing is hit; other columns are ignored.
    """
    each = unfold(judge(docs, benchmark, width), "m", "_i")
    return each.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "spans")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows.

    Rows are judged by their whole text, however long, so equal texts fare alike; null and empty texts have no words and stay, whatever their id; an empty
    benchmark removes nothing and an empty table stays empty; other columns, whatever their names, come along.
    """
    bad = judge(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    got = wrapped(docs, id=F.col("doc_id"), hash=F.xxhash64("text"))
    return got.join(bad, F.expr("id <=> k_id and hash = k_hash"), "left_anti").select("row.*")


def mask_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, words``: the normalised words of each row outside the hit spans (span removal).

    A row for each row of ``docs``, equal ones too; null and empty texts give no words; an empty benchmark leaves all words; other columns are ignored.
    """
    found = scan(docs, benchmark, width).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "spans")
    joined = docs.select("doc_id", F.xxhash64("text").alias("_h"), words(ascii_lower(F.col("text")), NON_WORD).alias("w")).join(found, F.expr("doc_id <=> _d and _h = _t"))
    return joined.select("doc_id", F.expr("filter(w, (x, i) -> not exists(spans, s -> i >= s.s and i < s.e))").alias("words"))
