import random
import re
import string

import pytest

from kgivm.llm import op2_ngram_jaccard_join as op2

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def corpus(seed, n_bases=12, copies=8):
    r = random.Random(seed)
    v = [f"W{i}" for i in range(400)]
    texts = [None, "", "a", "A", "a b", "a b c", "A b C d", " \n ", "é É"]
    passage = [r.choice(v) for _ in range(40)]
    for _ in range(n_bases):
        base = [r.choice(v) for _ in range(r.choice([5, 9, 12, 30, 60, 120, 300]))] + passage * r.randint(0, 1)
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [r.choice(v)], [r.choice(v), w[at]]])
                w = w or ["x"]
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 90, False), (5, 80, False), (3, 90, True), (2, 80, True)])
def test_equals_brute_force(spark, docs, k, percent, small, monkeypatch):
    if small:  # families of several chunks
        monkeypatch.setattr(op2, "CHUNK_DOCS", 3)
    texts = corpus(k * percent + small, copies=14 if small else 8)
    got = op2.jaccard_components(docs(spark, texts), k=k, percent=percent).collect()
    want = brute(texts, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(texts) - 10


def test_linked_sets_share_a_key():
    import numpy as np

    r = np.random.default_rng(5)
    for percent in (80, 90):
        ladder = op2.Ladder(percent)
        for _ in range(1500):
            n = int(r.integers(1, 120))
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            gone = int(r.integers(0, n // 4 + 1))
            b = np.concatenate([a[gone:], r.integers(0, 2**64, int(r.integers(0, n // 4 + 1)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and len(np.union1d(a, b)) > both:
                assert np.intersect1d(ladder.keys(a), ladder.keys(b)).size
                left = r.random() * 2**64  # any shingles may count as common
                assert np.intersect1d(ladder.keys(a, a[a > left]), ladder.keys(b, b[b > left])).size


def test_common_shingles_cost_no_link(spark, docs, monkeypatch):
    """Frequent shingles are left out of the blocking; copies made of nothing else are still found."""
    monkeypatch.setattr(op2, "COMMON_DOCS", 3)
    texts = corpus(77, n_bases=10, copies=12)
    frame = docs(spark, texts)
    common = op2.common_buckets(frame.select("text"), 3)
    counts = {}
    for s in {frozenset(shingle_set(t, 3)) for t in texts}:
        for g in s:
            counts[g] = counts.get(g, 0) + 1
    assert len(common) == sum(c >= 3 for c in counts.values()) > 100
    got = op2.jaccard_components(frame, k=3, percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 3, 90)


def test_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " tail"), (3, b), (9, c), (None, a), (8, c + " end"), (8, None)]
    got = op2.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.component_id is not None) == [(3, 48, 3), (5, 48, 3), (5, 48, 3), (7, 49, 3), (8, 0, 8), (8, 49, 8), (9, 48, 8)]


def test_group_above_the_chunk_size(spark, docs):
    """Near copies of one text, more than a chunk holds, and some that reach the group through one other only."""
    r = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    texts = [" ".join(w if r.random() > 0.004 else f"x{r.randrange(10**6)}" for w in base) + f" end{i}" for i in range(op2.CHUNK_DOCS + 300)]
    texts += [" ".join(base[:60] + [f"z{j}{i}" for i in range(60)]) for j in range(20)]
    got = op2.jaccard_components(docs(spark, texts), k=3, percent=90).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(texts, 3, 90)


def test_keep_first(spark, docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [text, text + " x", None, "other words", text, "other words"]
    frame = docs(spark, rows)
    kept = op2.keep_first(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3}
    assert op2.keep_first(docs(spark, [])).count() == 0
