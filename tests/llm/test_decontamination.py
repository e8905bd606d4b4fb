import hashlib
import random
import re
import string

import pytest

from kgivm.llm.op10_decontamination import Windows, build_index, decontamination, items_of, keep_clean, match, proximity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def brute(texts, items, width):
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for item, s in items:
            x = split(s)
            for a in range(max(1, len(x) - width + 1) if x else 0):
                v = x[a : a + width]
                for b in range(len(w) - len(v) + 1):
                    if w[b : b + len(v)] == v:
                        hit |= set(range(b, b + len(v)))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("width", [3, 10])
def test_equals_brute_force(spark, docs, width):
    r = random.Random(width)
    word = lambda: r.choice(["a", "b", "c", "É", "x1", "THE", "the"])
    text = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    texts = [None, "", "...", *(text(r.randint(0, 60)) for _ in range(40))]
    items = [(i, t) for i, t in enumerate([None, "", "!!", "a", "b c", *(text(r.randint(1, 15)) for _ in range(12)), texts[5], texts[5]])]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = decontamination(docs(spark, texts), bench, width=width).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got} == brute(texts, items, width)
    assert decontamination(docs(spark, []), bench).count() == 0
    assert not any(x.contaminated for x in decontamination(docs(spark, texts), bench.limit(0)).collect())


def test_proximity(spark, docs):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    w = Windows(items_of(bench))
    rows = ["blue x green x red", "red x x x x x green blue", "green", "blue red", None]
    index = build_index(docs(spark, rows))
    assert {r.doc_id for r in proximity(index, w, 4).collect()} == {0}
    assert {r.doc_id for r in proximity(index, w, 9).collect()} == {0, 1}


def test_one_index_serves_several_benchmarks(spark, docs):
    r = random.Random(7)
    texts = [None, "", *(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 80))) for _ in range(30)), "z " * 70_000 + "a b c y"]
    index = build_index(docs(spark, texts))
    for width, items in ((2, [(1, "a b c"), (2, "never seen")]), (5, [(1, "z z z a b c y"), (2, "f e d c b a f e"), (3, "q")]), (4, [])):
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in match(index, Windows(items, width)).collect()}
        assert got == brute(texts, items, width)


def test_windows_do_not_cross_documents(spark, docs):
    got = decontamination(docs(spark, ["a b", "c d", "a b c d"]), spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), width=3).collect()
    assert {x.doc_id: x.n_hit for x in got} == {0: 0, 1: 0, 2: 4}


def test_keep_clean(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = [(1, "x a b c"), (2, "a b"), (2, None), (None, "a b c"), (3, "c b a"), (1, "clean row of a dropped id")]
    docs = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, docs string")
    got = keep_clean(docs, bench, width=3)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(rows[1:5], key=str)
    assert keep_clean(docs.limit(0), bench).count() == 0
