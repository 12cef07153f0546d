"""Chat formatting: reply trees, their best branches, and a reversible turn template with a loss mask."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A backslash goes between < and | (further ones if there are some), so that no text holds a control string."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the (start, end) code points of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((_unrole(role), unescape(text[: -len(END) - 1])))
    return turns


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Root-to-leaf paths of the ``top`` best branches of each tree, a row for each node on a path: ``tree_id, leaf_id, depth_from_leaf, node_id``.

    ``nodes(tree_id, node_id, parent_id, score)``: node ids are unique within a tree and not null, roots have a null parent. Paths grow from the
    leaves by self-joins that double their length, so the rounds follow the logarithm of the depth and the rows the total path length. A branch's score is
    the sum over its nodes (null: 0); ties go to the smaller leaf. Nodes whose parent is missing, or that a cycle
    cuts off from a root, are on no path.
    """
    n = table(nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    inner = n.where("parent_id is not null").select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p")).distinct()
    leaf = n.join(inner, F.expr("tree_id <=> _t and node_id = _p"), "left_anti")
    path = leaf.select("tree_id", F.col("node_id").alias("leaf_id"), F.col("node_id").alias("at"), F.lit(0).cast("long").alias("depth"))
    jump = table(n.where("parent_id is not null").select(F.col("tree_id").alias("jt"), F.col("node_id").alias("jn"), F.col("parent_id").alias("up")), "jump")
    longest = n.groupBy("tree_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    step = 1
    while step < longest and not jump.isEmpty():
        path = table(path.union(path.join(jump, F.expr("tree_id <=> jt and at = jn")).select("tree_id", "leaf_id", F.col("up").alias("at"), (F.col("depth") + step).alias("depth"))), "path")
        far = jump.select(F.col("jt").alias("kt"), F.col("jn").alias("kn"), F.col("up").alias("kup"))
        jump = table(jump.join(far, F.expr("jt <=> kt and up = kn")).select("jt", "jn", F.col("kup").alias("up")), "jump")
        step *= 2
    scored = path.join(n.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), "parent_id", "score"), F.expr("tree_id <=> _t and at = _n"))
    best = scored.groupBy("tree_id", "leaf_id").agg(F.sum("score").alias("s"), F.max(F.col("parent_id").isNull()).alias("whole")).where("whole")
    best = best.withColumn("r", F.expr("row_number() over (partition by tree_id order by s desc, leaf_id)")).where(F.col("r") <= top).select(F.col("tree_id").alias("_t"), F.col("leaf_id").alias("_l"), F.col("r").alias("rank"))
    return path.join(best, F.expr("tree_id <=> _t and leaf_id = _l")).select("tree_id", "leaf_id", "rank", F.col("depth").alias("depth_from_leaf"), F.col("at").alias("node_id"))


def format_branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The chosen branches as text: ``tree_id, leaf_id, rank, formatted, loss_spans (start, end in code points)``.

    ``nodes`` also has ``role`` and ``text`` (null: empty). A branch is one row, so it is gathered in one place; other columns are ignored.
    """
    texts = nodes.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = branches(nodes, top).join(texts, F.expr("tree_id <=> _t and node_id = _n"))
    # rank and leaf name the branch
    each = rows.groupBy("tree_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth_from_leaf")).alias("o"), "role", "text"))).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                text, spans = render([(t["role"], t["text"]) for t in one.column("turns").to_pylist()[0]])
                yield pa.RecordBatch.from_arrays([one.column("tree_id"), one.column("leaf_id"), one.column("rank"), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], span)], ["tree_id", "leaf_id", "rank", "formatted", "loss_spans"])

    kinds = {c: each.schema[c].dataType.simpleString() for c in ("tree_id", "leaf_id", "rank")}
    return each.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", formatted string, loss_spans array<struct<start long, end long>>")


def threads(conversations: DataFrame) -> DataFrame:
    """Turn-ordered conversations as reply trees of one branch: each turn answers the one before it. Equal turns are ordered by role and text."""
    numbered = conversations.select(F.col("conv_id").alias("tree_id"), F.expr("row_number() over (partition by conv_id order by turn, role, text)").cast("long").alias("node_id"), "role", "text")
    return numbered.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the formatted text and its spans alone."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns, digest = parse(text), hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("tree_id"), *(pa.array(c) for c in zip(*rows, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
