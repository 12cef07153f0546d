import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import tokens
from foliant.llm.queries import op4_token_shards

from . import helpers as H

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", " a  b ", "tab\tx", "é, è. ñ!? x", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>,", "don't. it's, 'x'", "a b c", "x×y, ÷. 3.5, 12,",
    "foo.bar, baz...", "\x1c a", "a\r\nb c", "日本 語。 ok.", "a\x85b c", "word.\nNext one,\ntwo", "naïve... café!", "ª, º.", "a | b || c", "#tag ($5) [x]", "a b", "　a", "x\u0085", "Aa'S we'Ll", "é y", "²³ ½", "😀 ok😀",
]


def test_encoder_equals_the_library():
    tok, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    for part in (TEXTS, TEXTS[::-1], [t + " " + u for t in TEXTS for u in TEXTS], [t + u for t in TEXTS for u in TEXTS]):
        want = [np.array([*e.ids, 2], "<u2").tobytes() for e in tok.encode_batch(part, add_special_tokens=False)]
        assert enc.encode(part) == want
    assert enc.encode([]) == []


def test_long_words_are_told_apart():
    tok, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    t = [0]
    for _ in range(12):
        t += [1 - x for x in t]
    words = ["".join("ab"[x] for x in (y[:n])) for n in (1024, 2048, 4096) for y in (t, [1 - x for x in t])]
    want = [np.array([*e.ids, 2], "<u2").tobytes() for e in tok.encode_batch([*words, " ".join(words)], add_special_tokens=False)]
    assert len(set(want)) == 7 and enc.encode([*words, " ".join(words)]) == want


def test_equal_hashes_do_not_merge(monkeypatch):
    tok, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    monkeypatch.setattr(tokens, "range_hashes", lambda buf, a, b: np.zeros(len(a), np.uint64))
    want = [np.array([*e.ids, 2], "<u2").tobytes() for e in tok.encode_batch(TEXTS, add_special_tokens=False)]
    assert enc.encode(TEXTS) == want


def test_other_tokenizers_get_whole_texts(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    assert not enc.cuts and tokens.Encoder(PATH).cuts
    assert enc.encode(TEXTS) == [np.array([*e.ids, 2], enc.kind).tobytes() for e in tok.encode_batch(TEXTS, add_special_tokens=False)]


def test_store_names(tmp_path):
    from pyarrow import fs

    for p in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        where, at = tokens.store(p)
        assert isinstance(where, fs.LocalFileSystem) and at == str(tmp_path)


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    tok, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    for t in ("one two, three", "four, five. one two"):
        assert enc.encode([t]) == [np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes()]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 1000])
def test_perfect_hash_is_minimal(n):
    keys = np.arange(n) * 7 - 3
    h = tokens.key_hash(keys, np.zeros(n), np.zeros(n))
    _, at = tokens.perfect(h)
    assert sorted(at.tolist()) == list(range(n))


def test_shard_lookup():
    lengths = np.array([2, 0, 3])
    index = tokens.index_bytes(2, np.array([5, 5, 0]), np.array([0, 1, 0]), np.array([0, 0, 1]), lengths)
    s = tokens.Shard(index, np.arange(5, dtype="<u2").tobytes())
    assert s.ids(5).tolist() == [0, 1] and s.ids(5, 1).tolist() == [] and s.ids(None).tolist() == [2, 3, 4]
    assert sum(s.ids(k) is not None for k in range(100, 1100)) == 0
    with pytest.raises(ValueError):
        tokens.Shard(index, b"")
    with pytest.raises(ValueError):
        tokens.Shard(struct.pack(tokens.HEADER, b"NOPE", 1, 2, 0, 0, 0), b"")


def check(rows, texts):
    tok, at = Tokenizer.from_file(PATH), 0
    rows = sorted(rows, key=lambda r: r["start"])
    assert len(rows) == len(texts)
    for r, (doc, text) in zip(rows, texts, strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_table(spark, data):
    check(op4_token_shards(spark, data).collect(), sorted((r["doc_id"], r["text"]) for r in H.table(data, "documents")))


def test_odd_rows_in_small_shards(spark):
    order = sorted(((r[0], r[1]) for r in H.ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    made = tokens.write_shards(H.odd(spark), PATH, shard_ids=10)
    check(tokens.read_shards(made).collect(), order)
    assert tokens.read_shards(tokens.write_shards(H.empty(spark), PATH)).count() == 0
