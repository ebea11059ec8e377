import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tessera.llm import idfiles, lengths, packing, scan
from tessera.llm.common import new_path, utf8
from tessera.llm.encode import Encoder
from tessera.llm.queries import vocabulary
from tessera.llm.wordbpe import Merges, encode_texts, encoder

BITS = ["'", "s", "'s", "'ll", "'RE", "re", " ", "  ", "\n", "\t", "a", "B", "é", "É", "1", "٣", "½", "!", "?.", "😀", "\u00a0", "\u3000", "日本", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|", "'v", "'D", "`", "\u0301", "x'T", "Σ", "İ", "ẞ", "\x00", "\x85", "\x1c", "ﬁ"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "\n", "'", "''s", "the the the", "x" * 5000, "long word " * 3000]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_padding()
    t.no_truncation()
    return t


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)


def test_byte_level_ids_equal_the_library():
    texts, lib = fuzz(3000), library("byte_bpe_50k.json")
    ids, at = Encoder(vocabulary("byte_bpe_50k.json")).encode(*utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_may_be_emptied(monkeypatch):
    monkeypatch.setattr(scan, "MEMO_ENTRIES", 50)
    monkeypatch.setattr("tessera.llm.encode.CHUNK_BYTES", 100)
    texts, lib = fuzz(200), library("byte_bpe_50k.json")
    ids, at = Encoder(vocabulary("byte_bpe_50k.json")).encode(*utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_and_decoding_equal_the_library(spark):
    texts, lib = [None, *fuzz(3000, 2)], library("word_bpe_49k.json")
    df = table(spark, texts)
    got = {r.doc_id: r for r in encode_texts(df, vocabulary("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, t
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False), t
    digests = {r.doc_id: r for r in encode_texts(df, vocabulary("word_bpe_49k.json"), digest=True).collect()}
    assert all(digests[i].ids_sha256 == hashlib.sha256(got[i].ids).hexdigest() and digests[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest() for i in got)
    assert encode_texts(df.where("doc_id < 0"), vocabulary("word_bpe_49k.json")).count() == 0


def test_merges_skip_stale_entries():
    m = Merges({"a": 0, "b": 1, "ab": 2, "aba": 3, "ab</w>": 4, "b</w>": 5, "bab</w>": 6, "a</w>": 7}, [("a", "b"), ("b", "ab</w>"), ("a", "b</w>"), ("ab", "a")], "</w>")
    assert m.encode("abab") == [2, 4]
    assert m.encode("aba") == [2, 7]
    assert m.encode("a") == [7]
    e = encoder(vocabulary("word_bpe_49k.json"))
    assert e.word("a" * 4000)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50_257, idfiles.BLOCK * 40).astype(np.uint32)
    v[::97] = 2**32 - 1
    v[1024:2048] = 7
    v[2048:3072] = rng.integers(0, 2**32, 1024)
    v[3072:4096] = np.where(np.arange(1024) < 30, 2**31, 5)
    data, low, width, count = idfiles.pack_blocks(v)
    sizes = np.array([len(x) for x in data])
    back = idfiles.unpack_blocks(b"".join(data), np.cumsum(sizes) - sizes, low, width, count)
    assert (back.ravel() == v).all()
    assert width[1] == 0 and count[3] == 30 and sizes[1] == 0


def test_id_files_round_trip(spark):
    texts, lib = [None, "", *fuzz(300, 3), "word " * 40_000], library("byte_bpe_50k.json")
    df = table(spark, texts).union(spark.createDataFrame([(None, "null id", 1), (5, "again", 1)], "doc_id long, text string, n_tokens int"))
    folder = new_path(spark, "test-ids")
    path = vocabulary("byte_bpe_50k.json")
    files = idfiles.write_ids(df, path, 0, folder)
    rows = idfiles.read_ids(spark, folder, files, with_ids=True).orderBy("start").collect()
    order = sorted([(-1, "null id"), (5, "again"), *((i, t) for i, t in enumerate(texts))], key=lambda r: (r[0], r[1] is not None, r[1]))
    at = 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (None if i < 0 else i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    name, before, n = files[-1]
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{where}/{name}") as f:
        reader = idfiles.Reader(f)
        a, b = n // 3, n // 3 + 2500
        assert (reader.slice(a, min(b, n)) == whole[before + a : before + min(b, n)]).all()
    assert idfiles.write_ids(df.where("doc_id < -5"), path, 0, new_path(spark, "none")) == []


def test_packing(spark):
    texts = [None, "", *fuzz(400, 4), "many words here " * 4000, "many words here " * 4000]
    df, lib = table(spark, texts), library("byte_bpe_50k.json")
    rows = packing.pack(df, vocabulary("byte_bpe_50k.json"), 1, window=256)
    got = rows.collect()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) // 4 for r in own)
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 256
    assert len(by) <= sum(by.values()) / 256 * 1.02 + 1
    for r in packing.sequences(rows, pad_id=7).collect():
        own = b"".join(x.ids for x in sorted((x for x in got if x.sequence_id == r.sequence_id), key=lambda x: x.offset))
        assert r.n_tokens == by[r.sequence_id] == len(own) // 4 and len(r.ids) == 4 * r.padded_to
        assert r.ids == own + (7).to_bytes(4, "little") * (r.padded_to - r.n_tokens)
        assert r.padded_to == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 256)
    assert packing.pack(df.where("doc_id < 0"), vocabulary("byte_bpe_50k.json"), 1).count() == 0


def test_a_crowd_of_equal_rows_is_dealt_to_all_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 2000)
    df = spark.createDataFrame([(None, None)] * 3000 + [(5, "same text")] * 1000, "doc_id long, text string").repartition(4)
    rows = packing.pack(df, vocabulary("byte_bpe_50k.json"), 1, window=64)
    groups = [r[0] for r in rows.groupBy((rows.sequence_id / 2**32).cast("long")).count().select("count").collect()]
    assert sum(groups) == 4000 and len(groups) >= 7 and max(groups) < 1000
    packing.write_sequences(rows, str(tmp_path / "out"))
    ids = [np.frombuffer(r.ids, "<u4")[: r.n_tokens] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sum(int((x == 1).sum()) for x in ids) == 4000


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomial_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    texts = [f"{a}\n{b}", f"{a} {b}", f"{a} {b} {a}"]
    lib = library("byte_bpe_50k.json")
    raw = [t.encode() for t in texts]
    ids, at = Encoder(vocabulary("byte_bpe_50k.json")).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids
    words, ends, _, _ = encoder(vocabulary("word_bpe_49k.json")).texts(texts)
    want = [library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids for t in texts]
    assert words.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_a_clash_of_hashes_changes_nothing(monkeypatch):
    """Where the first hash confuses tokens, the second one shows it, and the ids are still the library's."""
    real = scan.span_hashes
    texts = ["some words and other words", "1234 abc!? some", "<|endoftext|> x"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    monkeypatch.setattr(scan, "span_hashes", lambda *a, **k: (real(*a, **k)[0] & np.uint64(3), real(*a, **k)[1]))
    ids, at = Encoder(vocabulary("byte_bpe_50k.json")).encode(data, off)
    want = [library("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and at.tolist() == [0, *np.cumsum([len(w) for w in want]).tolist()]
    words, ends, _, _ = encoder(vocabulary("word_bpe_49k.json")).texts(texts[:2])
    assert words.tolist() == sum((library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids for t in texts[:2]), [])


def test_best_fit_equals_a_plain_search():
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 64) for _ in range(400)), reverse=True)
    free = []
    for n in sizes:
        fits = [c for c in free if c >= n]
        if fits:
            c = min(fits)
            free.remove(c)
        else:
            c = 64
        free.append(c - n)
    where, offset = packing.best_fit_decreasing(sizes, 64)
    assert len(set(where)) == len(free)
    used = {}
    for w, o, n in zip(where, offset, sizes, strict=True):
        assert o == used.get(w, 0)
        used[w] = o + n
    assert sorted(64 - u for u in used.values()) == sorted(free)


def test_lengths(spark):
    texts, lib = [None, *fuzz(500, 6)], library("byte_bpe_50k.json")
    n = np.array([len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts])
    histogram = lengths.length_histogram(table(spark, texts), vocabulary("byte_bpe_50k.json"))
    sums = lengths.suffix_sums(histogram)
    for r in sums.collect():
        x = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == ((n == x).sum(), (n >= x).sum(), n[n >= x].sum(), np.minimum(n, x).sum())
        assert r.share_at_most == pytest.approx((n <= x).mean())
    assert [tuple(r) for r in lengths.totals_at(histogram, [0, 7, 10**6]).collect()] == [(x, np.minimum(n, x).sum(), (n > x).sum()) for x in (0, 7, 10**6)]
    assert [r.n_tokens for r in lengths.quantiles(sums, [0.5, 1.0]).collect()] == [np.sort(n)[-(-len(n) // 2) - 1], n.max()]
    assert lengths.token_counts(table(spark, texts).where("doc_id < 0"), vocabulary("byte_bpe_50k.json")).count() == 0


def test_vocabularies_stay_outside():
    assert not vocabulary("byte_bpe_50k.json").startswith(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_memo_forgets_what_does_not_recur(monkeypatch):
    monkeypatch.setattr(scan, "MEMO_ENTRIES", 20)
    memo, asked = scan.Memo(np.uint32), []

    def look(*keys):
        h = np.array(sorted(keys), np.uint64)

        def encode(which):
            asked.extend(h[which].tolist())
            return [[int(h[i]), int(h[i]) + 1] for i in which.tolist()]

        at = memo.find(h, h * 3, np.arange(len(h)), encode)
        assert [memo.flat[memo.start[p] : memo.start[p] + memo.length[p]].tolist() for p in at.tolist()] == [[k, k + 1] for k in sorted(keys)]

    look(1, 2, 3)
    look(2, 3, 4)
    look(*range(10, 24))
    assert len(memo.keys) == 18
    look(30, 31, 32)  # 2 and 3 came up again and stay
    assert sorted(memo.keys.tolist()) == [2, 3, 30, 31, 32]
    look(2, 3, 1)
    assert asked.count(2) == asked.count(3) == 1 and asked.count(1) == 2
    look(*range(40, 70))  # more than fits at once
    look(2)
    assert asked.count(2) == 2
