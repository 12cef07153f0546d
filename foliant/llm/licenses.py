"""Licence scans: one Aho-Corasick pass for notice phrases and tags, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces

#: Phrases (in words) and the label that each place stands for; the first three are the base ones.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license version 2": "apache-2.0",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
#: Labels that allow reuse without asking; an expression is permissive if a choice of its parts is.
PERMISSIVE = ("apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "cc-by", "cc-by-4.0", "cc0", "cc0-1.0", "isc", "mit", "unlicense", "zlib")

_SEEN = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def rpn(expression: str) -> list[str] | None:
    """The expression in postfix order (or < and < with, left to right); None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token ended an operand
    for t in _TOKEN.findall(expression):
        low = t.lower()
        if t == "(":
            if operand:
                break
            held.append(t)
        elif t == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break  # what follows is no longer part of it, as in a comment
            held.pop()
        elif low in _RANK:
            if not operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        else:
            if operand:
                break
            out.append(low)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def identifiers(expression: str) -> set[str]:
    """The identifiers of an expression that doesn't parse, up to where it stops being one."""
    out: set[str] = set()
    operand = False
    for t in (x.lower() for x in _TOKEN.findall(expression)):
        if t in _RANK:
            operand = False
        elif t not in "()":
            if operand:
                break
            out.add(t)
            operand = True
    return out


def evaluate(postfix: list[str], allowed=PERMISSIVE) -> tuple[set[str], bool]:
    """The labels in an expression, and whether it can be met with allowed licences alone (or: one side, and: both, with: the licence)."""
    stack: list[tuple[set[str], bool]] = []
    for t in postfix:
        if t in _RANK:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if t == "with":
                stack.append(({f"{x} with {y}" for x in a for y in b}, left))
            else:
                stack.append((a | b, left or right if t == "or" else left and right))
        else:
            stack.append(({t}, t in allowed))
    return stack[0]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str | None, machine) -> tuple[int, list[tuple[str, int]], list[tuple[str, bool | None]]]:
    """The number of words; the phrases with the word they start at; the labels of the tags' expressions, each with the expression's verdict (None if it is malformed)."""
    text = text or ""
    w = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    flat = (b" " + b" ".join(w) + b" ").decode("latin-1")
    found = sorted((end - len(p) - 1, p) for end, p in machine.iter(flat))
    hits, at, seen = [], 0, 0
    for start, p in found:
        seen += flat.count(" ", at, start + 1)
        at = start + 1
        hits.append((p, seen - 1))
    tagged = []
    if any(p == TAG for p, _ in hits):
        for m in _SEEN.finditer(text):
            post = rpn(m[1])
            labels, fine = evaluate(post) if post else (identifiers(m[1]), None)
            tagged += [(x, fine) for x in sorted(labels)]
    return len(w), [(p, i) for p, i in hits if p != TAG], tagged


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_words, hits (phrase, label, base, word), tags (label, permissive)``.

    Null and empty texts have no words. Phrases match whole words wherever they stand, overlapping ones too; long texts are scanned whole, each once. A malformed
    expression gives the identifiers that could be read, without a verdict (null). Equal rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    kind = "doc_id {}, n_words long, hits array<struct<phrase string, label string, base boolean, word long>>, tags array<struct<label string, permissive boolean>>".format(docs.schema["doc_id"].dataType.simpleString())

    def run(batches):
        machine = automaton()
        names = {**NOTICES, **BASE}
        hit = pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())]))
        tag = pa.list_(pa.struct([("label", pa.string()), ("permissive", pa.bool_())]))
        for batch in pieces(batches):
            n, hits, tags = [], [], []
            for t in batch.column("text").to_pylist():
                k, h, g = scan_text(t, machine)
                n.append(k)
                hits.append([{"phrase": p, "label": names[p], "base": p in BASE, "word": i} for p, i in h])
                tags.append([{"label": x.replace(",", " "), "permissive": fine} for x, fine in g])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, hit), pa.array(tags, tag)], ["doc_id", "n_words", "hits", "tags"])

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def license_report(docs: DataFrame) -> DataFrame:
    """``scan_licenses`` in the report's columns: base places, their first and last word, label lists, a score that rises with the labels, and ``tags_permissive``:
    whether all expressions can be met with permissive licences alone (null without a verdict on any, or without tags)."""
    s = scan_licenses(docs).withColumn("b", F.expr("filter(hits, h -> h.base)"))
    labels = F.array_sort(F.array_distinct(F.concat(F.expr("transform(hits, h -> h.label)"), F.expr("transform(tags, t -> t.label)"))))
    return s.select(
        "doc_id", "n_words", F.size("b").cast("bigint").alias("n_base"), F.expr("array_min(transform(b, h -> h.word))").alias("first_word"), F.expr("array_max(transform(b, h -> h.word))").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.expr("transform(b, h -> h.label)"))), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), (1 - F.pow(F.lit(0.5), F.size(labels))).alias("score"),
        F.expr("if(size(tags) = 0, null, forall(tags, t -> t.permissive))").alias("tags_permissive"),
    )
