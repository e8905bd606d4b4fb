import random
import re
from collections import Counter

import pyarrow as pa

from kgivm.llm.kernels import chunks
from kgivm.llm.op9_quality_rules import keep_good, measure, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text, min_words=10):
    w = WORD.findall(text)
    n = len(w)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    covered = {i + k for i in range(n) if best[i] >= min_words for k in range(best[i])}
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(covered), max([b for b in best if b >= min_words], default=0)]


def texts():
    r = random.Random(2)
    out = ["", None, "a", "a b", "a b c", "a b c a b c", " \n\n ", "x\nx\nx", "é é é é é é", "#* $\x0b%", "a b c d e f g h i j k\n" * 3]
    for _ in range(150):
        v = [chr(97 + i) for i in range(r.choice([1, 2, 3, 20]))]
        base = [r.choice(v) for _ in range(r.randint(0, 30))]
        if r.random() < 0.5:
            base = base * r.randint(1, 4)
        out.append("".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in base))
    return out


def test_measures_equal_brute_force():
    for limit in (100, 1 << 20):
        got = []
        for _, _, data, at in chunks(pa.array(texts(), pa.string()), limit):
            got += [list(map(int, row)) for row in zip(*measure(data, at, 10))]
        assert got == [brute(t or "") for t in texts()]


def test_verdicts(spark, docs):
    unique = " ".join(f"w{i}" for i in range(300))
    half = " ".join(f"w{i}" for i in range(100)) + " "
    rows = [unique, None, "", "too few words", half * 2, unique + " " + " ".join(f"w{i}" for i in range(20)), unique]
    got = {r.doc_id: r for r in quality(docs(spark, rows)).collect()}
    assert [got[i].kept for i in range(7)] == [True, False, False, False, False, True, True]
    assert [got[i].base_failed for i in range(7)] == [False, True, True, True, True, False, False]
    assert (got[4].covered_words, got[4].longest_repeat) == (200, 100)
    kept = keep_good(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {0, 5, 6}
    assert quality(docs(spark, [])).count() == 0


def test_repeats_under_a_shared_prefix():
    r = random.Random(7)
    rows = []
    for tail in (1, 2):
        for copies in (2, 3):
            names = [[f"name{i}x{k}" for k in range(tail)] for i in range(10)] * copies
            r.shuffle(names)
            # 9 common words, 1 or 2 of a name that comes again, and words of the line alone
            rows += [" ".join(f"c{i}v{v}" for i in range(9)) + " " + " ".join(name) + " " + " ".join(f"u{v}x{k}x{i}" for i in range(15)) for v in range(4) for k, name in enumerate(names)]
    texts_ = ["\n".join(rows[at : at + 20]) for at in range(0, len(rows), 20)]
    texts_ += ["\n".join(r.sample(rows[:20], 20)) for _ in range(2)]
    for limit in (100, 1 << 20):
        got = []
        for _, _, data, at in chunks(pa.array(texts_, pa.string()), limit):
            got += [list(map(int, row)) for row in zip(*measure(data, at, 10))]
        assert got == [brute(t) for t in texts_]
    assert brute(texts_[0])[5:] == [200, 10]
