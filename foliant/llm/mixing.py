"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, quoted, row_hash, table, unfold, words, wrapped

#: Fan-in of the reduction tree: the expected number of items that one fold works through.
FAN = 128
#: Size classes to an octave; a fold works through one class, and large classes are settled before small ones.
CLASSES = 4
#: Shares of a source's words, counted from its smallest texts: what lies above the first is settled first, then what lies above the next.
#: By how much the settled tiers are off leans the probabilities of the rest the other way.
TIERS = (0.5, 0.125, 0.015625)

# The state of a fold: the place c of the one fractional item, its probability x, and the places w that got their copy. Item i, of
# size b and probability y, meets item c, of size a: either c gains (at most g) what i loses or i gains what c loses (at most l),
# weighed by size, with the odds that keep both expectations; then one of the two is 0 or 1 and the words so far are unchanged.
_FOLD = """
aggregate(sequence(0, size(items) - 1),
  named_struct('c', -1, 'x', 0D, 'w', cast(array() as array<int>)),
  (s, i) -> if(s.c < 0, named_struct('c', i, 'x', items[i].p, 'w', s.w),
    aggregate(array(named_struct('y', items[i].p, 'r', items[i].size / items[s.c].size, 'u', items[i].u)), s, (z, t) -> case
      when t.u * (least(1D - z.x, t.y * t.r) + least(z.x, (1D - t.y) * t.r)) < least(z.x, (1D - t.y) * t.r) then
        if(1D - z.x <= t.y * t.r,
          named_struct('c', i, 'x', greatest(0D, t.y - (1D - z.x) / t.r), 'w', concat(z.w, array(z.c))),
          named_struct('c', z.c, 'x', z.x + t.y * t.r, 'w', z.w))
      when z.x <= (1D - t.y) * t.r then named_struct('c', i, 'x', least(1D, t.y + z.x / t.r), 'w', z.w)
      else named_struct('c', z.c, 'x', z.x - (1D - t.y) * t.r, 'w', concat(z.w, array(i))) end)))
"""
_U = "shiftrightunsigned(xxhash64({}), 11) / 9007199254740992D"


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes(source, source_size)`` with each source's ``target``: one row a source. The order of all sources and their sums are one task's, some 100 bytes a source
    that sort on disk where they must; a million sources take seconds.

    Sources in code point order, null last, take ``weights`` in turn. The targets fill up together in proportion to the
    weights; one that reaches ``cap`` times its source's size stops there and the rest goes on, which is the fixed point of
    resharing the excess until none is above.
    """
    cycle = ", ".join(f"{float(w)}D" for w in weights)
    return (
        sizes.withColumn("_w", F.expr(f"array({cycle})[cast((row_number() over (order by source is null, source) - 1) % {len(weights)} as int)]"))
        .withColumn("_top", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_all", F.expr(f"{float(share)}D * sum(source_size) over ()"))
        .withColumn("_o", F.expr("row_number() over (order by _top / _w, source is null, source)"))
        # with those before this one at their top, the level that the others would reach
        .withColumn("_done", F.expr("coalesce(sum(_top) over (order by _o rows between unbounded preceding and 1 preceding), 0D)"))
        .withColumn("_left", F.expr("sum(_w) over (order by _o rows between current row and unbounded following)"))
        .withColumn("_level", F.expr("(_all - _done) / _left"))
        .withColumn("_fill", F.expr("max(case when _level <= _top / _w then _level end) over ()"))
        .select("source", "source_size", F.expr("case when _fill is null then _top else least(_top, _fill * _w) end").alias("target"))
    )


def _round(level: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """One level of the tree: folds the items of each group; ``done`` has the decided ones, ``rest`` the residual with its probability."""
    kept = "s.size, s.h, s.doc_id, s.text_hash, s.m"
    u = _U.format(f"h, doc_id, text_hash, {depth}")
    grouped = level.withColumn("_it", F.expr(f"named_struct('size', size, 'h', h, 'doc_id', doc_id, 'text_hash', text_hash, 'm', m, 'p', p, 'u', {u})")).groupBy(*keys).agg(F.sort_array(F.collect_list("_it"), asc=False).alias("items"))
    fields = lambda s: kept.replace("s.", f"{s}.")
    return grouped.withColumn("f", F.expr(_FOLD)).select(
        *keys,
        F.expr(f"transform(filter(transform(items, (s, i) -> named_struct('s', s, 'i', i)), t -> t.i <> f.c), t -> named_struct({_named('t.s')}, 'win', array_contains(f.w, t.i)))").alias("done"),
        F.expr(f"named_struct({_named('items[f.c]')}, 'p', f.x)").alias("rest"),
    )


def _named(s: str) -> str:
    return ", ".join(f"'{c}', {s}.{c}" for c in ("size", "h", "doc_id", "text_hash", "m"))


def mix(rows: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often the mix takes each row of ``rows(doc_id, source, size, text_hash)``.

    Returns a row for each distinct input row: the same columns with ``m`` (how many equal rows there are), ``source_size``,
    ``target``, ``base`` (copies that each of them gets) and ``extra`` (how many of them get one more). The fractional parts are
    rounded by the pivotal method: two fractional items trade words at random until one is integral, and the residuals meet in
    a reduction tree of fan-in ``FAN`` within size classes, then across the classes of a source. Large texts are settled first, in
    ``TIERS``; what a tier's last residual is off is made up by the smaller texts, so only the smallest ones move the words off the target. Draws hash the row and the level, so reruns
    agree. Equal rows are counted before anything is grouped, so copies of one row, however many, are one item.
    """
    unit = rows.groupBy("source", "doc_id", "size", "text_hash").agg(F.count("*").alias("m"))
    unit = table(unit.withColumn("k", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * CLASSES).cast("int")).otherwise(-1)), "mix-units")
    classes = unit.groupBy("source", "k").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("m")).alias("words"))
    per = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    per = per.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    per_class = classes.alias("c").join(per.alias("t"), F.expr("c.source <=> t.source")).select(
        F.col("c.source").alias("_src"), F.col("c.k").alias("_k"), "source_size", "target", "ratio", F.ceil(F.col("n") / F.lit(FAN)).alias("blocks"),
        F.expr("sum(words) over (partition by c.source order by c.k) / source_size").alias("_below"))
    tier = F.lit(len(TIERS))
    for i, share_below in enumerate(TIERS):
        tier = F.when((F.col("_below") > share_below) & (tier == len(TIERS)), i).otherwise(tier)
    plan = table(per_class.withColumn("tier", tier).drop("_below"), "mix-plan")
    most = plan.agg(F.max("blocks")).first()[0] or 1
    unit = (
        unit.join(plan, F.expr("source <=> _src and k = _k")).drop("_src", "_k")
        .withColumn("base", F.floor("ratio").cast("bigint"))
        .withColumn("_f", (F.col("ratio") - F.col("base")) * F.col("m"))
        .withColumn("sure", F.floor("_f").cast("bigint")).withColumn("p", F.col("_f") - F.col("sure"))
        .withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(7)))
        .withColumn("block", F.expr("pmod(xxhash64(h, 1), blocks)"))
    )
    odd = F.expr("p > 1e-12 and p < 1 - 1e-12 and size > 0")
    won = unit.where(~odd).select("source", "doc_id", "size", "text_hash", F.when(F.expr("p > 0.5 and size > 0"), 1).otherwise(0).alias("win"))
    due = table(unit.where(odd).groupBy("source", "tier").agg(F.sum(F.col("p") * F.col("size")).alias("due"), F.sum("size").alias("room")), "mix-due")
    off = None  # how far the tiers settled so far are off, by source
    for i in range(len(TIERS) + 1):
        now = unit.where(odd).where(F.col("tier") == i)
        if off is not None:
            room = due.where(F.col("tier") >= i).groupBy("source").agg(F.sum("room").alias("room"))
            lean = room.join(off, F.expr("source <=> _s")).select(F.col("source").alias("_s"), (-F.col("off") / F.col("room")).alias("lean"))
            now = now.join(lean, F.expr("source <=> _s"), "left").withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.coalesce("lean", F.lit(0.0)))))
        settled = _settle(now, most, i * 16)
        won = won.union(settled)
        got = settled.groupBy("source").agg(F.sum(F.col("win") * F.col("size")).alias("got"))
        ask = due.where(F.col("tier") == i).select(F.col("source").alias("_a"), "due")
        here = ask.join(got, F.expr("source <=> _a"), "left").select(F.col("_a").alias("_s"), (F.coalesce("got", F.lit(0)) - F.col("due")).alias("off"))
        off = here if off is None else off.union(here)
        off = table(off.groupBy("_s").agg(F.sum("off").alias("off")), "mix-off")
    won = won.select(*[F.col(c).alias(f"_{c}") for c in ("source", "doc_id", "size", "text_hash")], "win")
    same = F.expr("source <=> _source and doc_id <=> _doc_id and size = _size and text_hash <=> _text_hash")
    return unit.join(won, same).select("source", "doc_id", "size", "text_hash", "m", "source_size", "target", "base", (F.col("sure") + F.col("win")).alias("extra"))


def _settle(unit: DataFrame, most: int, salt: int) -> DataFrame:
    """Every unit's ``win`` (0 or 1), by the reduction tree: blocks, then the classes, then the sources; a draw settles a source's last residual."""
    clear = F.expr("p <= 1e-9 or p >= 1 - 1e-9")
    won = unit.where(clear).select("source", "doc_id", "size", "text_hash", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("win"))
    levels = [table(_round(unit.where(~clear), ["source", "k", "block"], salt), "mix-level")]
    while most > 1:
        most = math.ceil(most / FAN)
        up = levels[-1].select("source", "k", F.expr(f"block div {FAN}").alias("block"), "rest.*")
        levels.append(table(_round(up, ["source", "k", "block"], salt + len(levels)), "mix-level"))
    levels.append(table(_round(levels[-1].select("source", "rest.*"), ["source"], salt + len(levels)), "mix-level"))
    last = F.expr(f"if({_U.format(f'h, doc_id, text_hash, {-1 - salt}')} < p, 1, 0)")
    won = won.union(levels[-1].select("source", "rest.*").select("source", "doc_id", "size", "text_hash", last.alias("win")))
    for lv in levels:
        won = won.union(lv.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.text_hash", F.col("d.win").cast("int").alias("win")))
    return table(won, "mix-settled")


def measured(docs: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Documents as ``mix`` wants them: the size is the number of words (null text: 0), the hash that of the text and the columns ``also``."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"), SPACES)).cast("bigint").alias("size"), (row_hash(docs.select("text", *[quoted(c) for c in also])) if also else F.xxhash64("text")).alias("text_hash"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, a row for each row of ``docs``.

    Null or empty text has size 0 and is taken 0 times its words; a null source is a source; equal rows are dealt their copies
    one by one; a source without words has target 0; long texts count whole; an empty table gives no rows; other columns are ignored.
    """
    each = unfold(mix(measured(docs), **how), "m", "_i")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("base") + F.when(F.col("_i") < F.col("extra"), 1).otherwise(0))).alias("taken"))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Null and empty texts hold no words and are not taken; a null source is a source; of equal rows (in all columns) each gets its copies; long texts count whole;
    an empty table stays empty; other columns, whatever their names or types, come along.
    """
    also = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    plan = mix(measured(docs, also), **how).select(*[F.col(c).alias(f"k_{c}") for c in ("source", "doc_id", "text_hash")], "m", (F.col("base") * F.col("m") + F.col("extra")).alias("copies"))
    plan = table(plan.where("copies > 0"), "mix-copies")
    got = wrapped(docs, source=F.col("source"), doc_id=F.col("doc_id"), text_hash=row_hash(docs.select("text", *[quoted(c) for c in also])) if also else F.xxhash64("text"))
    same = F.expr("source <=> k_source and doc_id <=> k_doc_id and text_hash = k_text_hash")
    once = got.join(plan.where("m = 1"), same)
    many = got.join(plan.where("m > 1"), same).dropDuplicates(["source", "doc_id", "text_hash"])
    return unfold(once.unionByName(many).select("row", "copies"), "copies", "i").select("row.*")
