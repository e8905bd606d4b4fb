import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontamination, test_jaccard, test_pii
from kgivm.llm.op9_quality_rules import quality

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    rows = [{r.doc_id: r for r in f.collect()} for f in frames[:5]]
    assert all(f.columns == docs.columns for f in frames[:5])

    good = {r.doc_id for r in quality(docs).collect() if r.kept}
    assert set(rows[1]) == good and len(good) > 0.5 * len(rows[0])
    ids = sorted(rows[1])
    groups = test_jaccard.brute([rows[1][i].text for i in ids], 5, 80)
    assert set(rows[2]) == {ids[g] for _, g in groups.values()}
    ids = sorted(rows[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = test_decontamination.brute([rows[2][i].text for i in ids], items, 10)
    assert set(rows[3]) == {ids[i] for i, x in hit.items() if not x[4]}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        before = test_pii.brute(rows[3][i].text)
        assert not test_pii.brute(r.text) and r.n_chars == len(r.text)
        if not before and "[PHONE]" not in r.text and "[CARD]" not in r.text and "[EMAIL]" not in r.text:
            assert r.text == rows[3][i].text
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for p in frames[5].collect():
        pieces[p.doc_id].append(p)
    for i, r in rows[4].items():
        ids = lib.encode(r.text, add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_take_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing names and empty tables pass every stage."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, None, "src", 5, "x"), (None, text + " tail", "en", None, None, None), (2, None, None, None, None, "y"), (3, "", "en", "s", 0, "z"), (1, text, None, "src", 5, "x"), (4, text + " a@b.cd", "en", "s", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _gone string")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF).cache()
            assert out.columns == docs.columns
            frame = out
        last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
        assert (last.count() > 0) == (frame.count() > 0)
