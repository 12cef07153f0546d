"""Token-id shards: raw ids in binary files, each with a minimal perfect hash index over its document keys."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces, text_buffer
from .common import scratch, table
from .hashing import range_hashes, same_ranges

#: The id that ends each document.
END_ID = 2
#: A shard is closed after so many ids.
SHARD_IDS = 16_000_000
#: Encoded pieces that a worker keeps.
CACHE = 600_000
#: Fixed values of the file format. Payload: the ids, little-endian, 2 bytes where the vocabulary allows, else 4. Index: header, then the arrays named below.
MAGIC, VERSION, HEADER = b"FOLT", 1, "<4sHHQQQ"
ARRAYS = (("displacements", "<i4"), ("fingerprints", "<u4"), ("starts", "<u8"), ("lengths", "<u8"), ("keys", "<i8"), ("repeats", "<u4"), ("nulls", "<u1"))

_CUT = re.compile(r" (?=\S)")
#: Letters, which the pre-tokenizer leaves whole, and marks after them, which it cuts off.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
#: Bytes that are, or may begin, white space other than blank and line break: texts with them take the general way.
_RARE = np.zeros(256, bool)
_RARE[[9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0xE1, 0xE2, 0xE3]] = True
_GAP = np.zeros(256, bool)
_GAP[[32, 10]] = True
def mix(x: np.ndarray) -> np.ndarray:
    """Part of the file format, so it stays as it is."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys, repeats, nulls) -> np.ndarray:
    """64 bits for each (doc_id, how many equal ids came before, whether it is null)."""
    with np.errstate(over="ignore"):
        k = mix(np.asarray(keys, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return mix(k ^ (np.asarray(repeats).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(nulls).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + (np.asarray(d).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)


def perfect(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct 64-bit hashes by hash and displace: a displacement for each bucket, and each key's slot.

    Large buckets go first and try displacements until all their slots are free; a bucket of one takes any free slot, stored as
    its negative minus one.
    """
    n = len(h)
    n_buckets = max(1, (n + 2) // 3)
    if not n:
        return np.zeros(n_buckets, "<i4"), np.zeros(0, np.int64)
    bucket = (h >> np.uint64(32)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket.astype(np.int64), minlength=n_buckets)
    first = np.concatenate([[0], np.cumsum(sizes)])
    taken, out, at = np.zeros(n, bool), np.zeros(n_buckets, "<i4"), np.zeros(n, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[sizes[by_size] > 1]:
        own = order[first[b] : first[b + 1]]
        k = h[own]
        for low in range(0, 1 << 30, 64):
            d = np.arange(low, low + 64)
            s = slot(k[None, :], d[:, None], n).astype(np.int64)
            free = ~taken[s].any(axis=1)
            srt = np.sort(s, axis=1)
            free &= (srt[:, 1:] != srt[:, :-1]).all(axis=1)
            if free.any():
                j = int(free.argmax())
                out[b], at[own], taken[s[j]] = d[j], s[j], True
                break
    single = by_size[sizes[by_size] == 1]
    places = np.flatnonzero(~taken)[: len(single)]
    out[single] = -places - 1
    at[order[first[single]]] = places
    return out, at


def index_bytes(width: int, keys: np.ndarray, repeats: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> bytes:
    h = key_hash(keys, repeats, nulls)
    displacements, at = perfect(h)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(lengths) else lengths
    slots = {"fingerprints": (h & np.uint64(0xFFFFFFFF)), "starts": starts, "lengths": lengths}
    out = [struct.pack(HEADER, MAGIC, VERSION, width, len(keys), len(displacements), int(lengths.sum()))]
    arrays = {"displacements": displacements, "keys": keys, "repeats": repeats, "nulls": nulls}
    for name, kind in ARRAYS:
        if name in slots:
            a = np.zeros(len(keys), kind)
            a[at] = slots[name]
        else:
            a = np.asarray(arrays[name]).astype(kind)
        out.append(a.tobytes())
    return b"".join(out)


class Shard:
    """A shard read back; ``ids(doc_id)`` costs the same however many documents there are."""

    def __init__(self, index: bytes, payload: bytes):
        magic, version, self.width, self.n, buckets, self.n_ids = struct.unpack_from(HEADER, index)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard index")
        at = struct.calcsize(HEADER)
        for name, kind in ARRAYS:
            n = buckets if name == "displacements" else self.n
            setattr(self, name, np.frombuffer(index, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.payload = np.frombuffer(payload, f"<u{self.width}")
        if len(self.payload) != self.n_ids:
            raise ValueError("the payload is not whole")

    def find(self, keys, repeats, nulls) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether its fingerprint is the stored one."""
        h = key_hash(keys, repeats, nulls)
        if not self.n:
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        d = self.displacements[((h >> np.uint64(32)) % np.uint64(len(self.displacements))).astype(np.int64)].astype(np.int64)
        at = np.where(d < 0, -d - 1, slot(h, np.maximum(d, 0), self.n).astype(np.int64))
        return at, self.fingerprints[at] == (h & np.uint64(0xFFFFFFFF))

    def ids(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        (at,), (ok,) = self.find([doc_id or 0], [repeat], [doc_id is None])
        return self.payload[int(self.starts[at]) : int(self.starts[at] + self.lengths[at])] if ok else None


def cuts_hold(config: dict) -> bool:
    """Whether a tokenizer's file is of the kind whose texts may be cut as ``Encoder`` does: byte-level pieces by the usual pattern, no normalizer, and no added token that a cut or the model alone would miss."""
    cutter = config.get("pre_tokenizer") or {}
    while cutter.get("type") == "Sequence" and len(cutter["pretokenizers"]) == 1:
        cutter = cutter["pretokenizers"][0]
    model = config.get("model") or {}
    plain = not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    whole = lambda t: _MARKED.fullmatch(t["content"]) or re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
    return config.get("normalizer") is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and model.get("type") == "BPE" and plain and not any(whole(t) for t in config.get("added_tokens") or [])


class Encoder:
    """Whole texts to ids, as the library encodes them, each distinct piece once for as long as it is kept.

    The byte-level pre-tokenizer always cuts before a space that a non-space character follows, around a single line break
    between such characters, and between letters and marks, so the pieces between such cuts can be encoded on their own. A batch's
    pieces are found and hashed as arrays, and bytes decide which are equal; only its distinct ones are looked up. Texts with other white space than
    single blanks and line breaks inside are cut in the general way. A tokenizer of another kind (``cuts_hold``) gets its texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_level = {c: 256 + i for i, c in enumerate(c for c in range(256) if c not in shown)}
        self.known: dict[bytes, bytes] = {}
        self.end = np.array([END_ID], self.kind).tobytes()
        self.cuts = cuts_hold(json.loads(self.tok.to_str()))
        self.line = self._one("\n")

    def _one(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, text: str) -> bytes:
        """A text that the pre-tokenizer leaves whole goes straight to the tokenizer's model, its bytes as byte-level characters."""
        if not text:
            return b""
        shown = text.replace(" ", "\u0120") if text.isascii() else text.encode().decode("latin-1").translate(self.byte_level)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _marks(self, text: str) -> bytes:
        """The marks after a word; short ones, of which there are few, are kept as the pieces that they are at a text's start."""
        if len(text) > 2:
            return self._word(text)
        k = text.encode()
        if k not in self.known:
            self.known[k] = self._word(text)
        return self.known[k]

    def _piece(self, text: str, gap: str) -> bytes:
        """A piece without white space, after a blank, a line break or nothing."""
        lead = " " if gap == " " else ""
        m = _MARKED.fullmatch(text)
        if not m:
            ids = self._one(lead + text)
        elif m[1] and m[2]:
            ids = (self.known.get((lead + m[1]).encode()) or self._word(lead + m[1])) + self._marks(m[2])
        elif m[1]:
            ids = self._word(lead + m[1])
        else:
            ids = self._word(lead + m[2])
        return self.line + ids if gap == "\n" else ids

    def _text(self, text: str) -> bytes:
        """Any text, cut at the spaces that a non-space character follows."""
        parts = _CUT.split(text)
        return b"".join([self._one(parts[0]) if parts[0] else b"", *(self._one(" " + p) for p in parts[1:])])

    def encode_flat(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts that lie in ``buf`` between ``offsets``, each with its end id, and how many each has."""
        n, docs = len(buf), len(offsets) - 1
        if not self.cuts:
            raw = buf.tobytes()
            each = [self._one(raw[a:b].decode()) + self.end for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(each), self.kind), np.array([len(x) // self.width for x in each], np.int64)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        gap = _GAP[buf]
        strange = _RARE[buf]
        strange[1:] |= gap[1:] & gap[:-1]
        strange[first] |= gap[first]
        strange[last] |= gap[last]
        odd = np.add.reduceat(strange, first) > 0 if len(first) else np.zeros(0, bool)
        gap &= ~np.repeat(odd, last - first + 1) if len(first) else gap
        begins = np.zeros(n + 1, bool)
        begins[1:] = gap
        begins = begins[:n]
        begins[first] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        edge = np.zeros(n + 1, np.uint8)
        edge[offsets] = 1
        ends -= edge[ends] == 0
        kind = np.where(edge[starts], 0, buf[np.maximum(starts - 1, 0)]).astype(np.uint64)
        edge[first[odd]] = 2
        # a piece is its bytes, with the blank or line break before it; those that share a hash count as one only if they are equal
        kind[edge[starts] == 2] = 3
        lead = starts - ((kind == 32) | (kind == 10))
        h = range_hashes(buf, lead, ends) + kind
        u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        other = np.flatnonzero(~(same_ranges(buf, lead, ends, at[inverse]) & (kind == kind[at[inverse]])))
        if len(other):
            inverse[other] = len(at) + np.arange(len(other))
            at = np.append(at, other)
        if len(self.known) > CACHE:
            self.known.clear()
        raw = buf.tobytes()
        keys = [raw[a:b] for a, b in zip(lead[at].tolist(), ends[at].tolist(), strict=True)]
        ids = [self.known.get(k) for k in keys]
        of = kind[at].tolist()
        for i in [i for i, k in enumerate(of) if k == 3 or ids[i] is None]:
            text = keys[i].decode()
            if of[i] == 3:
                ids[i] = self._text(text)
            elif of[i]:
                ids[i] = self.known[keys[i]] = self._piece(text[1:], text[0])
            else:
                ids[i] = self.known[keys[i]] = self._piece(text, "")
        ids.append(self.end)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.kind)
        where = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        # each text's pieces, then its end
        after = np.searchsorted(starts, offsets[1:])
        seq = np.insert(inverse, after, len(ids) - 1)
        each = sizes[seq]
        done = np.cumsum(each)
        out = flat[np.repeat(where[seq] - (done - each), each) + np.arange(done[-1] if len(done) else 0)]
        closes = done[after + np.arange(docs)] if docs else done
        return out, np.diff(np.concatenate([[0], closes]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        out, sizes = self.encode_flat(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])] if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of the file: its cache serves the next task too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Spark's names of object stores, and those that the workers' file systems know.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs", "gs": "gs", "gcs": "gs"}


def store(path: str):
    """The workers' file system and the path in it, for a path as Spark names it."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if not mark and path.startswith("file:"):
        scheme, mark, rest = "file", "://", path[5:]
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else path)


def write_shards(docs: DataFrame, tokenizer: str, to: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every text and writes the shards under ``to`` (default: the shared folder) in ascending ``doc_id`` order, nulls first.

    Returns the manifest, a row for each shard: ``shard, path, n_docs, n_ids, start`` (ids of all shards before it). Null text is empty; rows with
    equal ids are told apart by a running number, and all of them are one task's, in text order. Long texts are encoded whole; other columns are ignored.
    ``to`` may be any path that both Spark and the workers' file systems know (``store``). A shard is a ``.bin`` file of raw ids and a ``.idx`` file; a task's files have
    a name of their own and count only once the manifest names them, so a retried task leaves no trace.
    """
    spark = docs.sparkSession
    to = to or scratch(spark, "tokens")
    parts = docs.rdd.getNumPartitions()
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(max(parts, 1), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, where = TaskContext.get().partitionId(), store(to)
        where[0].create_dir(where[1], recursive=True)
        enc = encoder(tokenizer)
        body, keys, nulls, lengths, repeats = [], [], [], [], []
        n_ids = n = 0
        last, again = object(), 0

        def close():
            nonlocal body, keys, nulls, lengths, repeats, n_ids, n
            name = f"part-{part:06d}-{n:04d}-{uuid.uuid4().hex}"
            index = index_bytes(enc.width, np.array(keys, np.int64), np.array(repeats, np.int64), np.array(nulls, bool), np.array(lengths, np.int64))
            for end, data in ((".bin", body), (".idx", [index])):
                with where[0].open_output_stream(f"{where[1]}/{name}{end}") as f:
                    for x in data:
                        f.write(x)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": n, "path": f"{to}/{name}", "n_docs": len(keys), "n_ids": n_ids}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            body, keys, nulls, lengths, repeats, n_ids, n = [], [], [], [], [], 0, n + 1
            return row

        for batch in pieces(batches, most=4_000_000):
            ids, sizes = enc.encode_flat(*text_buffer(batch))
            at = 0
            for doc, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                again = again + 1 if doc == last else 0
                last = doc
                body.append(ids[at : at + size].tobytes())
                at += size
                keys.append(doc or 0)
                nulls.append(doc is None)
                repeats.append(again)
                lengths.append(size)
                n_ids += size
                if n_ids >= shard_ids:
                    yield close()
        if keys:
            yield close()

    made = table(ranged.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "token-manifest")
    return made.select(F.expr("cast(row_number() over (order by part, seq) - 1 as int)").alias("shard"), "path", "n_docs", "n_ids", F.expr("cast(coalesce(sum(n_ids) over (order by part, seq rows between unbounded preceding and 1 preceding), 0) as bigint)").alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, looked up by its key: ``doc_id, start, n_tokens, ids_crc32, shard``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                where, path = store(row["path"])
                data = []
                for end in (".idx", ".bin"):
                    with where.open_input_stream(path + end) as f:
                        data.append(f.read())
                s = Shard(*data)
                at, ok = s.find(s.keys, s.repeats, s.nulls)
                if not ok.all() or len(np.unique(at)) != s.n:
                    raise ValueError(f"the index of {row['path']} is broken")
                starts, lengths = s.starts[at].astype(np.int64), s.lengths[at].astype(np.int64)
                crc = [zlib.crc32(s.payload[a : a + n].astype("<u4").tobytes()) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys, mask=s.nulls.astype(bool)), pa.array(starts + row["start"]), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(s.n, row["shard"], np.int32))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
