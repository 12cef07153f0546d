"""Substring dedup: repeated passages go, their earliest occurrence stays.

Three kinds of pieces are compared, each by its digest over all texts: windows of ``least_words`` words at every word, which find what
stands inside other text; sentences of lines, whose runs go from ``least_words`` words on; and short whole lines. The steps:

1. ``_chunks``: chunks of words cut by their content. The windows of a chunk that stood earlier repeat, and the earliest chunk has them too.
2. ``_keys``: the 64-bit hashes of each text's sentences and lines, and of the least fragments of its other windows. Equal windows
   have equal least fragments, so a window whose fragment comes once can't repeat; this leaves out most windows and no repeated one.
3. ``_candidates``: the 128-bit digests of the pieces whose hash comes twice, without the windows known to repeat. All but the earliest place of each are repeated (``_later``).
4. ``_cut``: the words that repeated pieces cover, in maximal runs, mapped back to offsets.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import pieces, text_buffer
from .common import drop, release, table
from .hashing import mix, range_hashes, run_digests

#: A run of repeated units in a document goes if it holds so many words; so does any repeated run of words of that length.
LEAST_WORDS = 12
#: A repeated whole line goes if it holds so many words: more than a bare word or two.
LEAST_LINE = 3
#: Kinds of pieces, the lowest bits of a place.
UNIT, LINE, WINDOW, CHUNKED = range(4)
#: Words of a chunk, on average; the bits of a place that tell the word (above them stands the length of a chunk).
CHUNK, PLACE = 32, (1 << 31) - 1

#: Of so many texts one is looked at for digests that ``HOT`` of them hold; ``MOST_HOT`` such digests at most are broadcast, and their rows are dealt over ``SALTS``
#: tasks by text. That settles where rows are compared, never whether a piece repeats.
SAMPLE, HOT, MOST_HOT, SALTS = 64, 64, 200_000, 128

#: Where a unit ends: marks before white space, taken from the first one of their run so that a long run is read once, and line breaks.
_END = re.compile(r"(?<![.!?])[.!?]++(?=\s|\Z)|\n")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_FOLDED = np.frombuffer(_FOLD, np.uint8)
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_MARKS = re.compile(r"[^\s0-9A-Za-z\x80-\U0010ffff]*")
_STEPS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANE = np.uint64(0x9E3779B97F4A7C15)


def _pieces(text: str):
    """Start and end of the sentences of each line; a line without an end mark is one."""
    at = 0
    for m in _END.finditer(text):
        end = m.start() if m[0] == "\n" else m.end()
        if end > at:
            yield at, end
        at = m.end()
    if at < len(text):
        yield at, len(text)


def units(text: str) -> list[tuple[int, int, int, bytes]]:
    """Units of a text: the sentences of each line (a line without an end mark is one): start, end, words, 16-byte digest of the normalised words.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters; a piece without words is no unit.
    """
    out = []
    for a, b in _pieces(text):
        t = text[a:b]
        w = t.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        if w:
            out.append((a + len(t) - len(t.lstrip()), b - len(t) + len(t.rstrip()), len(w), hashlib.blake2b(b" ".join(w), digest_size=16).digest()))
    return out


def parts(text: str) -> list[tuple[int, int, int, int, int, bool]]:
    """The units and the lines of several units: kind, first word, words, start, end, whether it is a whole line."""
    out, line, at, word = [], [], 0, 0

    def close():
        if len(line) == 1:
            out[line[0]] = (*out[line[0]][:5], True)
        elif line:
            a, b = out[line[0]], out[line[-1]]
            out.append((LINE, a[1], b[1] + b[2] - a[1], a[3], b[4], True))

    for a, b in _pieces(text):
        t = text[a:b]
        n = len(_WORD.findall(t))
        if not n:
            continue
        if line and text.find("\n", at, a) >= 0:
            close()
            line = []
        line.append(len(out))
        out.append((UNIT, word, n, a + len(t) - len(t.lstrip()), b - len(t) + len(t.rstrip()), False))
        at, word = b, word + n
    close()
    return out


def _words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of folded texts start and end."""
    n = len(low)
    solid = low != 32
    full = offsets[:-1] < offsets[1:]
    joined = np.zeros(n + 1, bool)  # whether a byte and the one before it are of one word
    joined[1:n] = solid[1:] & solid[:-1]
    joined[offsets[:-1][full]] = False
    starts = np.flatnonzero(solid & ~joined[:n])
    return starts, np.flatnonzero(solid & ~np.append(joined[1:n], np.zeros(min(n, 1), bool))) + 1


def _word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the normalised words of the texts in ``buf``, where each begins, and where each text's words begin among them."""
    low = _FOLDED[buf]
    starts, ends = _words(low, offsets)
    return range_hashes(low, starts, ends), starts, np.searchsorted(starts, offsets)


def _spaced(buf: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether white space (as in ``_END``) begins at these bytes."""
    x, y, z = (np.append(buf, np.zeros(3, np.uint8))[i + k] for k in range(3))
    wide = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x80) & ((z >= 0x80) & (z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    return (x >= 9) & (x <= 13) | (x >= 28) & (x <= 32) | (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | wide


def _breaks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes where pieces end, and those where lines do."""
    marks = np.flatnonzero((buf == 46) | (buf == 33) | (buf == 63)) + 1
    marks = marks[_spaced(buf, marks) | np.isin(marks, offsets)]
    lines = np.union1d(np.flatnonzero(buf == 10) + 1, offsets)
    return np.union1d(marks, lines), lines


def _runs(breaks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of what stands between breaks and has words."""
    at = np.searchsorted(breaks, starts, "right")
    first = np.flatnonzero(np.append(np.ones(min(len(at), 1), bool), at[1:] != at[:-1]))
    return first, np.append(first[1:], len(at))[: len(first)]


def _ranges(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``parts`` of all texts in ``buf``: kind, first word and end among the batch's words."""
    breaks, lines = _breaks(buf, offsets)
    (ua, ub), (la, lb) = _runs(breaks, starts), _runs(lines, starts)
    several = np.searchsorted(ua, lb) - np.searchsorted(ua, la) > 1
    return np.repeat([UNIT, LINE], [len(ua), several.sum()]), np.concatenate([ua, la[several]]), np.concatenate([ub, lb[several]])


def _rolled(h: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """A hash of the ``width`` words from each word on."""
    n = max(len(h) - width + 1, 0)
    s = h[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            s = (s ^ (s >> np.uint64(29))) * step + h[k : n + k]
        return mix(s)


def _least(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows that lie in one text: their text and first word; the least fragment hash of each; the hashes of all fragments."""
    each = _rolled(h, (width + 1) // 2, _STEPS[0])
    n = max(len(h) - width + 1, 0)
    least = each[:n].copy()
    for k in range(1, width - (width + 1) // 2 + 1):
        np.minimum(least, each[k : n + k], out=least)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    p = np.flatnonzero(np.arange(n) + width <= at[1:][row[:n]])
    return row, p, least[p], each


def _in_text(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One key for a hash and its text within a batch."""
    with np.errstate(over="ignore"):
        return mix(x + row.astype(np.uint64) * _LANE)


def _chunks(width: int):
    """Chunks that begin where the hash of the next words says so, each with the ``width - 1`` words after it: all windows that begin in it."""

    def run(batches):
        for batch in pieces(batches):
            h, _, at = _word_hashes(*text_buffer(batch))
            each = _rolled(h, (width + 1) // 2, _STEPS[0])
            a = np.union1d(np.flatnonzero(each % np.uint64(CHUNK) == 0), at[:-1][np.diff(at) > 0])
            row = np.searchsorted(at, a, "right") - 1
            b = np.minimum(np.append(a[1:], len(h))[: len(a)] + width - 1, at[row + 1])
            keep = b - a >= width
            a, b, row = a[keep], b[keep], row[keep]
            d1, d2 = run_digests(h, a, b)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(a - at[row]), pa.array(b - a), pa.array(d1), pa.array(d2)], ["doc_id", "text_hash", "at", "len", "d1", "d2"])

    return run


def _open(known: pa.ListArray, at: np.ndarray, p: np.ndarray, width: int) -> np.ndarray:
    """Whether the windows at ``p`` lie outside the repeated chunks of their texts. Those inside are known to repeat; each stands, outside, in an earlier place."""
    us = known.flatten().to_numpy()
    a = at[np.repeat(np.arange(len(known)), known.fill_null([]).value_lengths().to_numpy())] + (us >> 2 & PLACE)
    n = at[-1] + 1
    return (np.cumsum(np.bincount(a, minlength=n) - np.bincount(a + (us >> 33) - width + 1, minlength=n)) == 0)[p]


def _keys(width: int):
    def run(batches):
        for batch in pieces(batches):
            buf, offsets = text_buffer(batch)
            h, starts, at = _word_hashes(buf, offsets)
            row, p, least, each = _least(h, at, width)
            keep = _open(batch.column("us"), at, p, width)
            p, least = p[keep], least[keep]
            _, one = np.unique(_in_text(least, row[p]), return_index=True)
            every = np.sort(_in_text(each, row[: len(each)]))
            mine = _in_text(least[one], row[p[one]])
            twice = one[np.searchsorted(every, mine, "right") - np.searchsorted(every, mine, "left") > 1]
            one = np.concatenate([one, twice])  # twice if it repeats within the text
            _, a, b = _ranges(buf, offsets, starts)
            d, _ = run_digests(h, a, b)
            take = pa.array(np.concatenate([row[a], row[p[one]]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(np.concatenate([d, least[one].view(np.int64)]))], ["doc_id", "text_hash", "key"])

    return run


def _candidates(width: int):
    def run(batches):
        for batch in pieces(batches):
            buf, offsets = text_buffer(batch)
            h, starts, at = _word_hashes(buf, offsets)
            row, p, least, _ = _least(h, at, width)
            keys = batch.column("keys")
            held = _in_text(keys.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy()))
            p = p[np.isin(_in_text(least, row[p]), held) & _open(batch.column("us"), at, p, width)]
            one, two = _rolled(h, width, _STEPS[0])[p], _rolled(mix(h ^ _LANE), width, _STEPS[1])[p]
            kind, a, b = _ranges(buf, offsets, starts)
            d1, d2 = run_digests(h, a, b)
            keep = np.isin(_in_text(d1.view(np.uint64), row[a]), held)
            kind, a, d1, d2 = kind[keep], a[keep], d1[keep], d2[keep]
            first = np.concatenate([a, p])
            take = pa.array(row[first])
            place = (first - at[row[first]]) * 4 + np.concatenate([kind, np.full(len(p), WINDOW)])
            arrays = [batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(place), pa.array(np.concatenate([d1, one.view(np.int64)])), pa.array(np.concatenate([d2, two.view(np.int64)]))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "at", "d1", "d2"])

    return run


def cut(text: str, repeated: set[int], least_words: int) -> tuple[int, list[tuple[int, int]], str]:
    """The number of units, the spans that go, and what is left: maximal runs of the words that repeated pieces (by place) cover.

    This states the rule for one text; ``_cut`` does the same for a batch, and the tests compare them.
    """
    if not repeated:
        return sum(1 for a, b in _pieces(text) if _WORD.search(text, a, b)), [], text
    all_ = parts(text)
    own = [x for x in all_ if x[0] == UNIT]
    gone = [x for x in all_ if x[5] and x[2] >= LEAST_LINE and x[1] * 4 + x[0] in repeated]
    i = 0
    while i < len(own):
        j = i
        while j < len(own) and own[j][1] * 4 + UNIT in repeated:
            j += 1
        if sum(x[2] for x in own[i:j]) >= least_words:
            gone += own[i:j]
        i = max(j, i + 1)
    n = own[-1][1] + own[-1][2]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, [x[1] for x in gone], 1)
    np.add.at(edges, [x[1] + x[2] for x in gone], -1)
    p = np.array([x >> 2 for x in repeated if x & 3 == WINDOW], np.int64)
    np.add.at(edges, p, 1)
    np.add.at(edges, p + least_words, -1)
    c = np.array([x for x in repeated if x & 3 == CHUNKED], np.int64)
    np.add.at(edges, c >> 2 & PLACE, 1)
    np.add.at(edges, (c >> 2 & PLACE) + (c >> 33), -1)
    covered = np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]]).astype(np.int8)
    begins, stops = np.flatnonzero(np.diff(covered) == 1).tolist(), np.flatnonzero(np.diff(covered) == -1).tolist()
    first, last = {x[1]: x[3] for x in gone}, {x[1] + x[2]: x[4] for x in gone}
    words = [m.span() for m in _WORD.finditer(text)] if begins else []
    spans = []
    for a, b in zip(begins, stops, strict=True):
        s, e = words[a][0], _MARKS.match(text, words[b - 1][1]).end()
        k = s
        while k and _MARKS.fullmatch(text[k - 1]):
            k -= 1
        if k == 0 or text[k - 1].isspace():  # marks after a word go with that word
            s = k
        spans.append((min(s, first.get(a, s)), max(e, last.get(b, e))))
    left, at = [], 0
    for a, b in spans:
        left.append(text[at:a])
        at = b
    return len(own), spans, "".join([*left, text[at:]])


def _covered(buf: np.ndarray, offsets: np.ndarray, row: np.ndarray, us: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units of each text; the text of each run of covered words; in bytes, the run's start and end and the pieces that a repeated unit or line begins and ends with there, or -1."""
    starts, ends = _words(_FOLDED[buf], offsets)
    n, at = len(starts), np.searchsorted(starts, offsets)
    breaks, lines = _breaks(buf, offsets)
    (ua, ub), (la, lb) = _runs(breaks, starts), _runs(lines, starts)
    kind = us & 3
    first = at[row] + np.where(kind == CHUNKED, us >> 2 & PLACE, us >> 2)
    stop = first + np.where(kind == CHUNKED, us >> 33, width)

    def flags(*words):
        out = np.zeros(n + 1, bool)
        out[np.concatenate(words)] = True
        return out

    unit, line = flags(first[kind == UNIT]), flags(first[kind == LINE])
    several = np.searchsorted(ua, lb) - np.searchsorted(ua, la) > 1
    whole = np.where(several, line[la], unit[la]) & (lb - la >= LEAST_LINE)
    text, rep = np.searchsorted(at, ua, "right") - 1, unit[ua]
    new = np.ones(len(ua), bool)
    new[1:] = (rep[1:] != rep[:-1]) | (text[1:] != text[:-1])
    run = np.cumsum(new) - 1
    long = rep & (np.bincount(run, ub - ua)[run] >= width) if len(ua) else rep
    begin, end = flags(la[whole], ua[long]), flags(lb[whole], ub[long])
    some = kind >= WINDOW
    edges = np.bincount(np.concatenate([first[some], la[whole], ua[long]]), minlength=n + 1) - np.bincount(np.concatenate([stop[some], lb[whole], ub[long]]), minlength=n + 1)
    covered, edge = np.cumsum(edges)[:n] > 0, flags(at)
    a = np.flatnonzero(covered & (edge[:n] | ~np.append(False, covered)[:n]))
    b = np.flatnonzero(covered & (edge[1:] | ~np.append(covered, False)[1:])) + 1
    i, j = np.searchsorted(breaks, starts[a], "right"), np.searchsorted(breaks, ends[b - 1])
    own = np.stack([starts[a], ends[b - 1], *(np.where(begin[a], breaks[x], -1) for x in (i - 1, i)), *(np.where(end[b], breaks[x], -1) for x in (j - 1, j))])
    return np.bincount(text, minlength=len(offsets) - 1), np.searchsorted(at, a, "right") - 1, own


def _span(text: str, s: int, e: int, p: int, q: int, u: int, v: int) -> tuple[int, int]:
    """A run of words from ``s`` to ``e`` with the marks that go with it, and the rest of the pieces ``p`` to ``q`` and ``u`` to ``v``."""
    k = s
    while k and (c := text[k - 1]) < "\x80" and not c.isalnum() and not c.isspace():
        k -= 1
    if k == 0 or text[k - 1].isspace():  # marks after a word go with that word
        s = k
    e = _MARKS.match(text, e).end()
    return min(s, q - len(text[p:q].lstrip())) if p >= 0 else s, max(e, u + len(text[u:v].rstrip())) if u >= 0 else e


def _cut(width: int):
    """``cut`` for all texts of a batch: words, pieces and what is covered in numpy, then a step a span."""
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in pieces(batches):
            buf, offsets = text_buffer(batch)
            us = batch.column("us")
            row = np.repeat(np.arange(batch.num_rows), us.fill_null([]).value_lengths().to_numpy())
            n, at, own = _covered(buf, offsets, row, us.flatten().to_numpy(), width)
            points = np.append(0, np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64))
            own = np.where(own >= 0, points[own] - points[offsets[at]], -1).T.tolist()
            bounds = np.searchsorted(at, np.arange(batch.num_rows + 1))
            left, spans, gone = batch.column("text").to_pylist(), [], np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                t, kept, k = left[i], [], 0
                for x in own[bounds[i] : bounds[i + 1]]:
                    a, b = _span(t, *x)
                    kept.append(t[k:a])
                    gone[i] += b - a
                    spans.append((a, b))
                    k = b
                left[i] = "".join([*kept, t[k:]])
            a, b = np.array(spans, np.int64).reshape(-1, 2).T
            removed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(struct)))
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(gone), removed, pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_units", "n_removed", "removed_chars", "removed", "text"])

    return run


def _table(df: DataFrame, name: str) -> DataFrame:
    """``table``, whose shuffle files go as soon as it is written; Spark's cleaner may come to them a step later."""
    conf, flag = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(flag, None)
    conf.set(flag, "true")
    try:
        return table(df, name)
    finally:
        conf.unset(flag) if before is None else conf.set(flag, before)


def _hot(rows: DataFrame, *key: str) -> DataFrame:
    """``h0 ...``: the keys that many of a sample's rows hold, a table of bounded size."""
    often = rows.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") >= HOT).orderBy(F.desc("c"), *key).limit(MOST_HOT)
    return _table(often.select(*[F.col(k).alias(f"h{i}") for i, k in enumerate(key)]), "hot")


def _salt(held: str):
    return F.when(F.col(held).isNotNull(), F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))).otherwise(F.lit(-1))


def _later(rows: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """All rows but those at the earliest place of their digest. A hot digest's rows are ranked in parts, then the first of each part among themselves."""
    order = F.col("doc_id").isNull(), "doc_id", "text_hash", "at"
    at = rows.join(F.broadcast(hot), F.expr("d1 = h0 and d2 = h1"), "left").withColumn("salt", _salt("h0"))
    ranked = at.withColumn("r", F.rank().over(Window.partitionBy("d1", "d2", "salt").orderBy(*order)))  # rows equal in id and text are one document
    part = _table(ranked.where("r > 1 or h0 is not null").drop("h0", "h1"), name)
    heads = part.where("r = 1").withColumn("r", F.rank().over(Window.partitionBy("d1", "d2").orderBy(*order))).where("r > 1")
    return part.where("r > 1").unionByName(heads).drop("salt", "r")


def dedup_substrings(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_units, n_removed, removed_chars, removed (start, end), text``.

    A run of ``least_words`` or more words that stands elsewhere goes wherever it starts and ends; so does a run of repeated units (sentences
    of lines) with as many words, and a repeated whole line of ``LEAST_LINE`` words or more. Pieces with equal digests are one passage; the
    occurrence with the smallest (doc_id, place) stays, null ids last. Offsets are code points
    of the original text, ``text`` is what is left. Null text stays null with no units, empty text stays empty; texts of any length are read whole, in time in
    proportion to it; rows equal in id and text are one document and get the same result; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    some = base.where("text is not null")
    few = some.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SAMPLE)) == 0)
    own = F.expr("doc_id <=> _d and text_hash = _h")
    names = F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")

    def chunks(rows):
        return rows.mapInArrow(_chunks(least_words), f"doc_id {kind}, text_hash long, at long, len long, d1 long, d2 long")

    chunk = _later(chunks(some), _hot(chunks(few), "d1", "d2"), "chunk")
    chunk = _table(chunk.groupBy(*names).agg(F.collect_set(F.expr(f"shiftleft(shiftleft(len, 31) + at, 2) + {CHUNKED}")).alias("us")), "chunks")
    release(spark)

    def keys(rows):
        return rows.join(chunk, own, "left").select("doc_id", "text_hash", "text", "us").mapInArrow(_keys(least_words), f"doc_id {kind}, text_hash long, key long")

    hot = _hot(keys(few), "key")
    key = keys(some).join(F.broadcast(hot), F.col("key") == F.col("h0"), "left").withColumn("salt", _salt("h0"))
    shared = key.withColumn("c", F.count("*").over(Window.partitionBy("key", "salt"))).where("c > 1 or h0 is not null")
    known = chunk.select(F.col("_d").alias("_e"), F.col("_h").alias("_g"), "us")
    shared = shared.groupBy(*names).agg(F.collect_set("key").alias("keys")).join(known, F.expr("_d <=> _e and _h = _g"), "left").drop("_e", "_g")
    shared = _table(shared, "shared")
    release(spark)

    def found(rows):
        return rows.join(shared, own).select("doc_id", "text_hash", "text", "keys", "us").mapInArrow(_candidates(least_words), f"doc_id {kind}, text_hash long, at long, d1 long, d2 long")

    gone = _later(found(some), _hot(found(few), "d1", "d2"), "found")
    gone = _table(gone.groupBy(*names).agg(F.collect_set("at").alias("us")), "gone")
    drop(shared)
    del key, shared
    release(spark)
    gone = gone.unionByName(chunk).groupBy("_d", "_h").agg(F.flatten(F.collect_list("us")).alias("us"))
    held = base.join(gone, own, "left").select("doc_id", "text", "us")
    return held.mapInArrow(_cut(least_words), f"doc_id {kind}, n_units long, n_removed long, removed_chars long, removed array<struct<start long, end long>>, text string")
