import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kgivm.llm import scratch
from kgivm.llm.op1_curve_packing import curve_packing, hilbert
from kgivm.llm.op6_token_counts import proven_table, token_counts, whole_tokens
from kgivm.llm.op8_token_files import read_index, read_tokens, token_digest, write_tokens
from kgivm.llm.pretokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "don't", "'s", " 's", "!'s", "''s", "a'sx'll", "x  y", "\n\n a", "\t\tb", "a b", "1234 56", "É'tÊ", "İstanbul ǅ", "é", "<|endoftext|> x",
    "a<|startoftext|>b", "日本語 テスト", "🙂👍🏽", "' '", "'re've", "ab\r\ncd", "½²³", "１２", "word " * 5000, "x" * 3000,
]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "style"), [(BYTE, "byte"), (WORD, "word")])
def test_encoder_equals_the_library(path, style):
    import pyarrow as pa

    r = random.Random(1)
    alphabet = ["'", "s", "t", "r", "e", "l", " ", "\n", "1", "a", "!", "É", "\xa0", "d", "m", "v", "́", "İ"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    enc = Encoder(path, style)
    got = []
    for lo, hi, ids, bounds in enc.batches(pa.array(texts, pa.string()), 5000):
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    texts = ODD + ODD
    got = {r.doc_id: r for r in token_counts(docs(spark, texts), BYTE, limit=10).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 10)
    assert token_counts(docs(spark, []), BYTE).count() == 0


def test_whole_tokens_are_proven():
    lib = Tokenizer.from_file(BYTE)
    proven = whole_tokens(BYTE)
    assert len(proven) > 40_000
    assert all(lib.encode(t, add_special_tokens=False).ids == [proven[t]] for t in list(proven)[::97])


def test_proven_tokens_need_no_merging_and_stay():
    lib, enc, whole = Tokenizer.from_file(BYTE), Encoder(BYTE, "byte"), whole_tokens(BYTE)
    enc.seed(*proven_table(BYTE))
    words = [t for t in whole if t.isalpha() and t.isascii()][:5000:7]
    for _ in range(2):
        for text, merged in (("".join(" " + w for w in words if " " + w in whole), False), (" qqzzqvxj kkqwzzj", True)):
            data = np.frombuffer(text.encode(), np.uint8)
            ids, bounds = enc.encode(data, np.array([0, len(data)]), None)
            assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]
            assert (enc.misses > 0) == merged
        enc.clear()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_round_trip(spark, docs, encoding):
    lib = Tokenizer.from_file(WORD)
    path = scratch.folder(spark)
    write_tokens(docs(spark, ODD), path, WORD, encoding=encoding)
    want = [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in ODD]
    starts = np.cumsum([0, *map(len, want)])
    got = {r.doc_id: r for r in token_digest(spark, path).collect()}
    assert {i: (got[i].start, got[i].n_tokens, got[i].ids_crc32) for i in got} == {i: (starts[i], len(w), crc(w)) for i, w in enumerate(want)}
    assert {r.doc_id: r.start for r in read_index(spark, path).collect()} == {i: starts[i] for i in range(len(ODD))}
    (row,) = read_tokens(spark, path, where="doc_id = 2").collect()
    assert row.ids == want[2]


def test_files_of_no_documents(spark, docs):
    path = scratch.folder(spark)
    write_tokens(docs(spark, []), path, WORD)
    assert token_digest(spark, path).count() == 0


def test_packing(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    texts = ODD + ["same text"] * 50
    rows = curve_packing(docs(spark, texts), BYTE, length=64).collect()
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        short += at < 64
    assert short <= 4
    assert curve_packing(docs(spark, []), BYTE).count() == 0


def test_hilbert_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
