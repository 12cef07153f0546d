"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

The join is exact. Its steps:

1. ``shingle_sets``: every text becomes its sorted set of 64-bit shingle hashes. Texts with one set (by 128-bit digest) are one class, so
   copies are joined by their digest and only one of them goes on. A class carries a parity bitmap; its first hashes in a common order (a
   prefix longer by ``l`` than what an overlap of ``t`` leaves out, so that linked sets share ``l`` prefix hashes at least) are its keys. Hashes
   that very many classes hold, such as those of a common passage, come last in that order, so only near copies of each other have them as keys.
2. Live keys: prefix hashes that a second class holds. The texts are hashed again for them, which is cheaper than to keep
   them. A key that few classes hold (``GROUP``) gives their pairs, a row of three numbers each; the other keys are crowded.
3. Candidate edges: of the pairs, those met on as many keys as linked sets of their sizes share, less the crowded keys that both may share besides;
   their bitmaps are compared too: the bits in which these differ bound the overlap from above. A pair that meets on crowded keys alone shares all it must there.
   Only classes that hold enough of these are sent to tiles of bounded size, larger groups by bands of sizes. Within a tile only sets whose sizes are in band meet, by bitmaps.
   What passes is kept as a spanning forest, so that a tile gives fewer rows than it has members.
4. The components of these edges are the groups that can hold links. Those of more than a block are compared once more by
   bitmaps as wide as the sets, which parts long texts that narrow bitmaps can't tell apart.
   The sets of the groups left are gathered once, in blocks; each block pair counts its exact intersections and gives each
   class's number of links and a spanning forest.
5. The components of the links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces, text_buffer
from .common import drop, joined, release, slots, table, wrapped
from .hashing import mix, range_hashes

#: Words of a shingle; two sets link when 100 * intersection >= NEAR * union.
WIDTH, NEAR = 5, 75
#: Bits of a bitmap: the power of two nearest the set's size, at least these; in the tiles of keys at most the latter.
LEAST_BITS, MOST_BITS = 256, 2048
#: The side of all members of a tile that pairs a block with itself.
SELF = 2
#: Members of a tile, of a block of full bitmaps, and of a block of sets.
TILE, WIDE_BLOCK, BLOCK = 4096, 512, 256
#: Up to so many classes (about 40 bytes each) are broadcast to pick their texts; beyond that the texts are joined by a shuffle.
BROADCAST_CLASSES = 500_000
#: Prefix hashes that one task groups, on average.
KEYS_PER_TASK = 1_500_000
#: Of so many classes the set of one is looked at for hashes that at least ``HOT`` of them hold; ``MOST_HOT`` such hashes at most are broadcast. Which they are
#: settles the order of prefixes and who counts them, never whether a pair is found.
SAMPLE, HOT, MOST_HOT = 64, 64, 200_000
#: Tasks among which a hot hash's classes are dealt.
SALTS = 64
#: Of a key that so many classes hold at most, each pair is a row; the others are crowded and go to tiles.
GROUP = 8
#: The step of the codes that tell about how large a set is; sizes of linked sets are ``CODES`` codes apart at most.
STEP, CODES = 1.06, 6
#: A posting's tag is its salt below this, and the size's code times this.
TAG = 128
#: Classes whose digests agree in the first half; about n * n / 2**65 of n classes do.
MOST_TWINS = 10_000
#: Sizes of linked sets differ by less than this factor, so that their bands are neighbours whatever the rounding.
BAND = 0.74

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NONE = np.zeros(0, np.uint64)
def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that lie in ``buf`` between ``offsets``, and where each text's words begin among them."""
    n = len(buf)
    solid = ~_SPACE[buf]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return range_hashes(_FOLD[buf], starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than ``width`` the whole sequence is one, without words there is none."""
    h, at = word_hashes(buf, offsets)
    with np.errstate(over="ignore"):
        if len(h) >= width:
            s = h[: len(h) - width + 1].copy()
            for k in range(1, width):
                s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - width + 1 + k]
            s = mix(s)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                x = np.sort(s[a : b - width + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                out.append(x[keep])
            elif b > a:
                x = h[a : a + 1].copy()
                for k in range(a + 1, b):
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k]
                out.append(mix(x ^ np.uint64(b - a)))
            else:
                out.append(h[:0])
    return out


def spare(n):
    """How many prefix hashes, beyond the first, two linked sets of about ``n`` share at least."""
    return n // 20


def least_shared(n: int) -> int:
    """Prefix hashes that a set of ``n`` shares with any set it links with: the smaller of the two may have 3/4 of its size."""
    return 1 + spare(-(-NEAR * n // 100))


def prefix(s: np.ndarray, hot: np.ndarray = _NONE) -> np.ndarray:
    """The first hashes of a set in the common order: those that few sets hold before the ``hot`` ones, by value within either."""
    n = len(s)
    if len(hot) and n:
        held = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
        if held.any():
            s = np.concatenate([s[~held], s[held]])
    return s[: n - (-(-NEAR * n // 100)) + 1 + spare(n)]


def bits_of(n: int) -> int:
    return max(LEAST_BITS, 1 << round(math.log2(max(n, 1))))


def bitmap(s: np.ndarray, w: int) -> bytes:
    """Bit i of ``w`` is the parity of the number of hashes that fall on it."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (w - 1), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def size_code(n: int) -> int:
    return min(255, int(math.log(n) / math.log(STEP)))


#: The least size that has a code, rounded down.
_SIZES = np.array([int(STEP**k * (1 - 1e-9)) for k in range(256)], np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two numbers."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _name(digest: tuple[int, int], shared: frozenset[int]) -> int:
    """A class's 64-bit name: the first half of its digest, or the second where two classes have that first half."""
    return digest[1] if digest[0] in shared else digest[0]


def _new_classes(batches, digest):
    """The batches with their sets, each set's digest, and whether this task meets that class for the first time (or has forgotten it)."""
    met: set[tuple[int, int]] = set()
    for batch in pieces(batches):
        sets = shingle_sets(*text_buffer(batch))
        ds = [digest(s) if len(s) else None for s in sets]
        new = []
        for d in ds:
            new.append(d is not None and d not in met)
            if new[-1]:
                if len(met) > 1_000_000:
                    met.clear()
                met.add(d)
        yield batch, sets, ds, new


def _classes(digest):
    """For each document its class; the bitmaps, and of each ``SAMPLE``-th class the set, go with the first document of a class that this task meets."""
    def run(batches):
        for batch, sets, ds, new in _new_classes(batches, digest):
            bits = [bits_of(len(s)) for s in sets]
            maps = [bitmap(s, min(MOST_BITS, w)) if x else None for s, w, x in zip(sets, bits, new, strict=True)]
            wide = [bitmap(s, w) if x and w > MOST_BITS else None for s, w, x in zip(sets, bits, new, strict=True)]
            some = [s.tobytes() if x and d[1] % SAMPLE == 0 else None for s, d, x in zip(sets, ds, new, strict=True)]
            half = lambda i: pa.array([d and d[i] for d in ds], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), half(0), half(1), pa.array(maps, pa.binary()), pa.array(wide, pa.binary()), pa.array(some, pa.binary())],
                ["doc_id", "text_hash", "n", "d", "e", "map", "wide", "some"],
            )

    return run


def _sampled(batches):
    """The sets of sampled classes, hash by hash: ``d, key``."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("some").to_pylist()]
        if sets:
            d = np.repeat(batch.column("d").to_numpy() ^ batch.column("e").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.concatenate(sets))], ["d", "key"])


def _postings(digest, shared: frozenset[int], sent):
    """The prefix hashes of each class that this task meets: ``d, key, tag``; a hot key's rows are dealt by the class."""

    def run(batches):
        hot = sent.value
        for _, sets, ds, new in _new_classes(batches, digest):
            chosen = [(_name(d, shared), size_code(len(s)), prefix(s, hot)) for s, d, x in zip(sets, ds, new, strict=True) if x]
            if chosen:
                times = [len(k) for _, _, k in chosen]
                d = np.repeat(np.array([d for d, _, _ in chosen], np.int64), times)
                key = np.concatenate([k for _, _, k in chosen])
                tag = np.repeat(np.array([c * TAG for _, c, _ in chosen], np.int16), times)
                if len(hot):
                    held = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    tag[held] += ((d[held] & (SALTS - 1)) + 1).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(key.view(np.int64)), pa.array(tag)], ["d", "key", "tag"])

    return run


def _live(group: int):
    """Keys that two classes hold, of one task's share of the keys. Up to ``group`` classes are paired: ``a, b, need``, the number of keys that they share
    at least if they link. Of crowded keys each class is a row, ``a, key, times``; hot keys are known to be held often, their ``times`` is null."""

    def run(batches):
        ks, ds, ts = [], [], []
        for b in batches:
            ks.append(b.column("key").to_numpy())
            ds.append(b.column("d").to_numpy())
            ts.append(b.column("tag").to_numpy())
        if not ks:
            return
        k, d, t = np.concatenate(ks), np.concatenate(ds), np.concatenate(ts)
        del ks, ds, ts
        o = np.lexsort((d, k))
        k, d, t = k[o], d[o], t[o]
        same = np.zeros(len(k), bool)
        same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        k, d, t = k[~same], d[~same], t[~same]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(start, len(k)))
        hot = (t[start] & (TAG - 1)) > 0
        code = (t // TAG).astype(np.int64)
        for m in range(2, group + 1):
            at = start[(size == m) & ~hot]
            for low in range(0, len(at), 20_000):
                x = at[low : low + 20_000]
                for i in range(m):
                    for j in range(i + 1, m):
                        near = np.abs(code[x + i] - code[x + j]) <= CODES
                        p, q = x[near] + i, x[near] + j
                        need = (1 + spare(_SIZES[np.minimum(code[p], code[q])])).astype(np.int32)
                        none = pa.nulls(len(p), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(d[p]), pa.array(d[q]), pa.array(need), none, pa.nulls(len(p), pa.int32())], ["a", "b", "need", "key", "times"])
        keep = np.repeat(hot | (size > group), size)
        keep &= np.repeat(hot | (size > 1), size)
        times, held = np.repeat(size, size)[keep].astype(np.int32), np.repeat(hot, size)[keep]
        k, d = k[keep], d[keep]
        for i in range(0, len(k), 100_000):
            part = slice(i, i + 100_000)
            n = len(k[part])
            yield pa.RecordBatch.from_arrays([pa.array(d[part]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(k[part]), pa.array(times[part], mask=held[part])], ["a", "b", "need", "key", "times"])

    return run


def _runs(batches, key: str):
    """The rows of a sorted stream, key by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        edge = np.flatnonzero(k[1:] != k[:-1]) + 1
        at = 0
        for e in [*edge.tolist(), len(k)]:
            part = b.slice(at, e - at)
            if held and held[0].column(key)[0].as_py() != k[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            at = e
    if held:
        yield pa.Table.from_batches(held)


def _fold(maps: list[bytes], bits: int) -> np.ndarray:
    """The bitmaps folded to ``bits`` (halves meet by exclusive or, which keeps parities), as rows of 64-bit words."""
    out = np.zeros((len(maps), bits // 64), np.uint64)
    for size in {len(m) for m in maps}:
        rows = [i for i, m in enumerate(maps) if len(m) == size]
        x = np.frombuffer(b"".join(maps[i] for i in rows), np.uint64).reshape(len(rows), -1)
        while x.shape[1] * 64 > bits:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[rows] = x
    return out


def may_link(n_a, n_b, differ) -> np.ndarray:
    """Whether sets of these sizes whose bitmaps differ in so many bits can link: overlap <= (a + b - differ) / 2, needed is (a + b) * t / (1 + t)."""
    return (100 + NEAR) * (n_a + n_b - differ) >= 2 * NEAR * (n_a + n_b)


def _pair_edges(batches):
    """The pairs ``a, b`` whose sizes and bitmaps (``na, nb, ma, mb``) let them link."""
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        ma, mb = batch.column("ma").to_pylist(), batch.column("mb").to_pylist()
        width = np.array([min(len(x), len(y)) * 8 for x, y in zip(ma, mb, strict=True)], np.int64)
        ok = (NEAR * np.maximum(na, nb) <= 100 * np.minimum(na, nb)) if len(na) else np.zeros(0, bool)
        for w in np.unique(width).tolist():
            (at,) = np.nonzero(ok & (width == w))
            differ = np.bitwise_count(_fold([ma[i] for i in at], w) ^ _fold([mb[i] for i in at], w)).sum(axis=1).astype(np.int64)
            ok[at] = may_link(na[at], nb[at], differ)
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def tile_forest(n: np.ndarray, maps: list[bytes], side: np.ndarray | None = None) -> np.ndarray:
    """A label for each member of a tile (sorted by size): those that chains of passing pairs connect share one. side: if given, only pairs across."""
    m = len(n)
    forest = _Forest(m)
    bits = sorted({len(x) * 8 for x in maps})
    folded = {}
    for w in bits:
        rows = [i for i in range(m) if len(maps[i]) * 8 >= w]
        x = np.zeros((m, w // 64), np.uint64)
        x[rows] = _fold([maps[i] for i in rows], w)
        folded[w] = x
    width = np.array([len(x) * 8 for x in maps])
    ends = np.searchsorted(n, n * 100 // NEAR, side="right")
    label = np.arange(m)
    for i in range(m - 1):
        js = np.arange(i + 1, ends[i])
        if not len(js):
            continue
        js = js[label[js] != label[i]]
        if side is not None:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        x = folded[width[i]]
        near = width[js] >= width[i]
        differ = np.zeros(len(js), np.int64)
        differ[near] = np.bitwise_count(x[js[near]] ^ x[i]).sum(axis=1)
        if not near.all():  # sizes rise, widths hardly fall; the narrower width serves both
            for j in np.flatnonzero(~near):
                y = folded[width[js[j]]]
                differ[j] = int(np.bitwise_count(y[js[j]] ^ y[i]).sum())
        good = js[may_link(n[i], n[js], differ)]
        if len(good):
            gone = np.unique(label[np.append(good, i)])
            label[np.isin(label, gone)] = gone.min()
    return label


def _tile_edges(batches):
    """Spanning forests of the tiles: ``a, b``. Tiles of two, which are most, are compared all at once."""
    done: set[tuple[int, int]] = set()
    two: list[tuple] = []

    def flush():
        nonlocal two
        if not two:
            return None
        by: dict[int, list[tuple]] = {}
        for t in two:
            by.setdefault(min(len(t[2]), len(t[5])) * 8, []).append(t)
        a, b = [], []
        for w, ts in by.items():
            differ = np.bitwise_count(_fold([t[2] for t in ts], w) ^ _fold([t[5] for t in ts], w)).sum(axis=1).astype(np.int64)
            ok = may_link(np.array([t[1] for t in ts]), np.array([t[4] for t in ts]), differ)
            a += [t[0] for t, x in zip(ts, ok, strict=True) if x]
            b += [t[3] for t, x in zip(ts, ok, strict=True) if x]
        two = []
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for t in _runs(batches, "tile"):
        d, n, maps = t.column("d").to_numpy(), t.column("n").to_numpy(), t.column("map").to_pylist()
        if len(d) == 2:
            pair = (min(d), max(d))
            if NEAR * max(n) <= 100 * min(n) and pair not in done:
                if len(done) > 500_000:
                    done.clear()
                done.add(pair)
                two.append((d[0], n[0], maps[0], d[1], n[1], maps[1]))
                if len(two) >= 20_000 and (out := flush()) is not None:
                    yield out
            continue
        side = t.column("side").to_numpy()
        o = np.lexsort((d, n))
        d, n, maps = d[o], n[o], [maps[i] for i in o]
        label = tile_forest(n, maps, None if side[0] == SELF else side[o])
        (rest,) = np.nonzero(label != np.arange(len(d)))
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(d[rest]), pa.array(d[label[rest]])], ["a", "b"])
    if (out := flush()) is not None:
        yield out


def exact_links(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Which of the sets link, as pairs of places (i < j): bitmaps rule out most, the rest is decided by exact intersection.

    side: ``SELF`` in a block paired with itself; else 0 and 1, and only pairs across count.
    """
    n = np.array([len(s) for s in sets])
    both = side[0] != SELF
    w = bits_of(int(n.max()) * 2) if len(n) else LEAST_BITS
    maps = np.stack([np.frombuffer(bitmap(s, w), np.uint64) for s in sets]) if sets else np.zeros((0, w // 64), np.uint64)
    left, right = [], []
    for i in range(len(sets)):
        js = np.flatnonzero(side == 1) if both and side[i] == 0 else np.arange(i + 1, len(sets)) if not both else np.zeros(0, int)
        js = js[(NEAR * n[js] <= 100 * n[i]) & (100 * n[js] >= NEAR * n[i])]
        if len(js):
            js = js[may_link(n[i], n[js], np.bitwise_count(maps[js] ^ maps[i]).sum(axis=1).astype(np.int64))]
            left.append(np.full(len(js), i))
            right.append(js)
    if not left:
        return np.zeros((0, 2), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    if len(a) > 4 * len(sets):  # many pairs: all intersections at once, from the sorted arrays put on one axis
        _, where = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), n)
        common = np.zeros((len(sets), len(sets)), np.float32)
        o = np.argsort(where, kind="stable")
        where, row = where[o], row[o]
        for low in range(0, int(where[-1]) + 1, 8192):
            x, y = np.searchsorted(where, [low, low + 8192])
            part = np.zeros((len(sets), 8192), np.float32)
            part[row[x:y], where[x:y] - low] = 1
            common += part @ part.T
        inter = common[a, b].astype(np.int64)
    else:
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    ok = 100 * inter >= NEAR * (n[a] + n[b] - inter)
    return np.stack([a[ok], b[ok]], axis=1)


def _block_links(batches):
    """For each class of a block pair: how many documents it links with here (``links``) and a class that its component here holds (``to``)."""
    for t in _runs(batches, "tile"):
        d, copies = t.column("d").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("body").to_pylist()]
        pairs = exact_links(sets, t.column("side").to_numpy())
        if not len(pairs):
            continue
        links = np.zeros(len(d), np.int64)
        np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
        forest = _Forest(len(d))
        for i, j in pairs.tolist():
            forest.join(i, j)
        label = forest.labels()
        (own,) = np.nonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(d[label[own]]), pa.array(links[own])], ["d", "to", "links"])


def _bodies(digest, shared: frozenset[int]):
    def run(batches):
        for batch in pieces(batches):
            want = batch.column("want").to_numpy()
            sets = shingle_sets(*text_buffer(batch))
            keep = [i for i, s in enumerate(sets) if len(s) and _name(digest(s), shared) == want[i]]
            if keep:
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("want", "copies", "cluster", "members")), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["d", "copies", "cluster", "members", "n", "body"])

    return run


def _tiles(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows dealt into tiles. ``rows`` have ``d``, ``n`` (the set's size) and ``members`` (of the row's group ``key``).

    A group of one ``block`` is a tile. A larger one is cut into bands of sizes, so wide that sets which link are in one band or in neighbouring ones,
    and each band into blocks: each block meets each other block of its band and of the next, and itself, in a tile of two. ``side``
    is the block's place in it (``SELF``: a block paired with itself).
    """
    one = rows.where(F.col("members") <= block).withColumn("tile", F.col(key)).withColumn("side", F.lit(SELF)).drop("members")
    big = rows.where(F.col("members") > block).drop("members").withColumn("_band", F.floor(F.log(F.col("n").cast("double")) / -math.log(BAND)))
    per = table(big.groupBy(F.col(key).alias("_g"), F.col("_band").alias("_h")).agg(F.ceil(F.count("*") / F.lit(float(block))).cast("long").alias("_own")), "bands")
    side = lambda by, name: per.select(F.col("_g").alias(f"_g{name}"), (F.col("_h") + by).alias(f"_h{name}"), F.col("_own").alias(f"_{name}"))
    meets = per.join(side(-1, "up"), F.expr("_g = _gup and _h = _hup"), "left").join(side(1, "low"), F.expr("_g = _glow and _h = _hlow"), "left").select("_g", "_h", "_own", F.coalesce("_up", F.lit(0)).alias("_up"), F.coalesce("_low", F.lit(0)).alias("_low"))
    if per.count() <= BROADCAST_CLASSES:
        meets = F.broadcast(meets)
    at = big.join(meets, (F.col(key) == F.col("_g")) & (F.col("_band") == F.col("_h"))).withColumn("_b", F.expr("pmod(xxhash64(d), _own)"))
    # (the lower band, the upper, the place in the lower, the place in the upper, the side)
    run = lambda n, row: f"if({n} > 0, transform(sequence(0L, {n} - 1), o -> {row}), array())"
    row = "named_struct('a', _band + {a}, 'b', _band + {b}, 'i', {i}, 'j', {j}, 's', {s})".format
    own = row(a=0, b=0, i="least(o, _b)", j="greatest(o, _b)", s=f"case when _b > o then 1 when _b = o then {SELF} else 0 end")
    met = F.expr(f"concat({run('_own', own)}, {run('_up', row(a=0, b=1, i='_b', j='o', s=0))}, {run('_low', row(a=-1, b=0, i='o', j='_b', s=1))})")
    at = at.withColumn("_m", F.explode(met)).withColumn("tile", F.xxhash64(key, "_m.a", "_m.b", "_m.i", "_m.j")).withColumn("side", F.col("_m.s"))
    return one.unionByName(at.select(*one.columns))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(doc_id, text_hash, n, d)`` of all documents, ``classes(d, rep, n, copies)``, and ``found(d, to, links)``: the links of classes, a spanning forest of them."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    made = table(base.mapInArrow(_classes(_digest), f"doc_id {kind}, text_hash long, n long, d long, e long, map binary, wide binary, some binary"), "classes")

    def grouped(rows):
        least = F.min(F.struct(F.col("doc_id").isNull().alias("i"), "doc_id")).alias("rep")
        return table(rows.where("n > 0").groupBy("d").agg(least, F.max("n").alias("n"), F.count("*").alias("copies"), F.min("e").alias("_e"), F.max("e").alias("_f")), "class")

    # digests that agree in their first halves only are told apart by the second
    classes = grouped(made)
    twin = classes.where("_e <> _f").select("d").limit(MOST_TWINS + 1).collect()
    shared = frozenset(r["d"] for r in twin)
    if shared:
        if len(shared) > MOST_TWINS:
            raise RuntimeError(f"over {MOST_TWINS} sets agree in half a digest")
        drop(classes)
        made = made.withColumn("d", F.when(F.col("d").isin(*shared), F.col("e")).otherwise(F.col("d")))
        classes = grouped(made)
        if not classes.where("_e <> _f").isEmpty():
            raise RuntimeError("two sets agree in a half of their digests and a third one in the other")
    classes = classes.select("d", F.col("rep.doc_id").alias("rep"), "n", "copies")

    # hashes that many sampled classes hold come last in the common order
    often = made.where("some is not null").mapInArrow(_sampled, "d long, key long").distinct().groupBy("key").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "key").limit(MOST_HOT)
    hot = np.sort(often.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(hot)

    # keys of two classes at least, and what is left of each class
    first = made.where("map is not null")
    total = first.agg(F.sum(F.expr(f"n - ({NEAR} * n + 99) div 100 + 1 + n div 20"))).first()[0] or 0
    tasks = max(slots(spark), math.ceil(total / KEYS_PER_TASK))
    parts = base.mapInArrow(_postings(_digest, shared, sent), "d long, key long, tag short").repartition(tasks, "key", F.expr(f"tag % {TAG}"))
    met = table(parts.mapInArrow(_live(GROUP), "a long, b long, need int, key long, times int"), "met")
    crowded, pairs = met.where("key is not null").select(F.col("a").alias("d"), "key", "times"), met.where("key is null").select("a", "b", "need")
    del parts
    release(spark)
    maps = first.groupBy("d").agg(F.first("n").alias("n"), F.first("map").alias("map"))
    mine = crowded.groupBy(F.col("d").alias("_d")).agg(F.collect_list(F.struct("key", "times")).alias("live"))
    least = F.expr(f"1 + (({NEAR} * n + 99) div 100) div 20")
    left = table(maps.join(mine, F.expr("d = _d")).where(F.size("live") >= least).select("d", "n", "map", "live"), "left")

    # pairs met often enough; each side may have met the other on its crowded keys too
    often = crowded.groupBy(F.col("d").alias("_d")).agg(F.count("*").alias("_q"))
    near = pairs.repartition("a").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    for side in ("a", "b"):
        near = near.join(often, F.col(side) == F.col("_d"), "left").where(F.col("c") + F.coalesce("_q", F.lit(0)) >= F.col("need")).drop("_d", "_q")
    near = table(near.select("a", "b"), "near")
    of = lambda x: maps.select(F.col("d").alias(f"_{x}"), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}"))
    near_maps = near.join(of("a"), F.expr("a = _a")).join(of("b"), F.expr("b = _b")).select("a", "b", "na", "nb", "ma", "mb")
    paired = table(near_maps.mapInArrow(_pair_edges, "a long, b long"), "paired")
    del crowded, pairs, mine, often, near_maps, maps
    drop(met), drop(near)
    release(spark)

    # tiles of keys
    posted = left.select("d", "n", "map", F.explode("live").alias("k")).select("d", "n", "map", F.col("k.key").alias("key"), F.col("k.times").cast("long").alias("members"))
    if len(hot):
        often = F.broadcast(posted.where("members is null").groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("_c")))  # MOST_HOT rows at most
        posted = posted.join(often, F.col("key") == F.col("_k"), "left").withColumn("members", F.coalesce("members", "_c")).drop("_k", "_c")
    edges = _tiles(posted, "key", TILE).select("tile", "side", "d", "n", "map").repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(_tile_edges, "a long, b long")
    rough = table(joined(edges.unionByName(paired)), "clusters")
    del edges, posted
    drop(left), drop(paired)
    release(spark)

    # groups of more than a block once more, by the full bitmaps
    cluster, over = rough, _large(rough)
    if over is not None:
        full = first.select(F.col("d").alias("_d"), "n", F.coalesce("wide", "map").alias("map")).dropDuplicates(["_d"])
        big = rough.join(over, F.col("label") == F.col("_l")).join(full, F.col("node") == F.col("_d")).select(F.col("node").alias("d"), "label", "members", "n", "map")
        again = _tiles(big, "label", WIDE_BLOCK).select("tile", "side", "d", "n", "map").repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(_tile_edges, "a long, b long")
        small = rough.join(over.select("_l"), F.col("label") == F.col("_l"), "left_anti")
        cluster = table(small.select("node", "label").unionByName(joined(again)), "clusters")

    # sets of the clusters' classes, gathered in blocks
    over = _large(cluster)
    member = cluster.withColumn("members", F.lit(1).cast("long")) if over is None else cluster.join(over, F.col("label") == F.col("_l"), "left").select("node", "label", F.coalesce("members", F.lit(1)).alias("members"))
    member = member.join(classes, F.col("node") == F.col("d")).select(F.col("d").alias("want"), "rep", "copies", F.col("label").alias("cluster"), "members")
    if cluster.count() <= BROADCAST_CLASSES:
        member = F.broadcast(member)
    sets = base.join(member, F.expr("doc_id <=> rep")).select("text", "want", "copies", "cluster", "members").mapInArrow(_bodies(_digest, shared), "d long, copies long, cluster long, members long, n long, body binary")
    sets = table(sets.dropDuplicates(["d"]), "sets")
    met = _tiles(sets, "cluster", BLOCK).select("tile", "side", "d", "copies", "body").repartition(tasks, "tile").sortWithinPartitions("tile")
    found = table(met.mapInArrow(_block_links, "d long, to long, links long"), "links")
    del met
    drop(sets)
    release(spark)
    return made.select("doc_id", "text_hash", "n", "d"), classes, found


def _large(cluster: DataFrame) -> DataFrame | None:
    """``_l, members`` of the clusters over a block, to be joined (by broadcast while they are few); None if there is none."""
    out = table(cluster.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("members")).where(F.col("members") > BLOCK), "large")
    n = out.count()
    return None if not n else F.broadcast(out) if n <= BROADCAST_CLASSES else out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``, a row for each row of ``docs``.

    Documents link when their shingle sets have a Jaccard similarity of 0.75 or more; ``component_id`` is the smallest ``doc_id`` that links
    reach, the document itself included, and ``n_links`` the number of documents it links with, copies counted. Null and
    empty texts have no shingles and link with nothing. Rows with a null ``doc_id`` link like others but name no component
    (null where no row of theirs has an id); rows that share a ``doc_id`` are documents of their own. Other columns are ignored.
    """
    rows, classes, found = _linked(docs)
    comp = joined(found.select(F.col("d").alias("a"), F.col("to").alias("b")))
    named = classes.join(comp, F.col("d") == F.col("node"), "left").select("d", "rep", "copies", F.coalesce("label", "d").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id")).select(F.col("label").alias("_l"), "component_id")
    count = found.groupBy("d").agg(F.sum("links").alias("links")).select(F.col("d").alias("_k"), "links")
    done = named.join(least, F.col("label") == F.col("_l")).join(count, F.col("d") == F.col("_k"), "left").select(F.col("d").alias("_d"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "d").join(done, F.col("d") == F.col("_d"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id`` (null last), among rows that share it that of the least text hash.

    Of rows equal in both one stays. Rows without shingles (null, empty or blank text) link with nothing and all stay. Long texts are read whole;
    an empty table stays empty; other columns, whatever their names, come along.
    """
    rows, classes, found = _linked(docs)
    comp = joined(found.select(F.col("d").alias("a"), F.col("to").alias("b")))
    each = rows.where("n > 0").groupBy("d", "doc_id", "text_hash").agg(F.count("*").alias("m")).join(comp, F.col("d") == F.col("node"), "left")
    first = each.groupBy(F.coalesce("label", "d").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("i"), "doc_id", "text_hash", "m")).alias("f"))
    blank = rows.where("n = 0").select("doc_id", "text_hash", F.lit(0).cast("long").alias("m")).distinct()
    kept = table(first.select("f.doc_id", "f.text_hash", "f.m").unionByName(blank).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "m"), "kept")
    got = wrapped(docs, id=F.col("doc_id"), hash=F.xxhash64("text"))
    same = F.expr("id <=> k_id and hash = k_hash")
    # the rows that go, or stand more than once, are few: broadcast, the texts stay where they are read
    repeated = kept.where("m > 1")
    least = kept.select(F.col("k_id").alias("_i"), F.col("k_hash").alias("_h"))
    away = rows.where("n > 0").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct().join(least, F.expr("k_id <=> _i and k_hash = _h"), "left_anti")
    away = table(away.unionByName(repeated.select("k_id", "k_hash")), "away")
    if away.count() <= BROADCAST_CLASSES:
        once = got.join(F.broadcast(away), same, "left_anti")
        repeated = F.broadcast(repeated)  # among those of ``away``
    else:
        once = got.join(kept.where("m <= 1"), same, "left_semi")
    many = got.join(repeated, same, "left_semi").dropDuplicates(["id", "hash"])
    return once.unionByName(many).select("row.*")
