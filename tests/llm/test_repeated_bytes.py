import hashlib
import random

import pytest

from kgivm.llm.op7_repeated_bytes import removed


def brute(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], (i, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * (len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < (i, p):
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs, seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared = [line(r.choice([60, 99, 100, 101, 130, 260])) for _ in range(8)]
    texts = [None, "", "x" * 99, "x" * 350, "ab" * 200, "y" * 100, "y" * 100]
    for _ in range(50):
        texts.append("".join(r.choice([line(r.randint(0, 80)), r.choice(shared), r.choice(shared)[r.randint(0, 9) :]]) for _ in range(r.randint(1, 5))))
    texts += r.sample(texts, 10)
    base = line(900)
    for _ in range(8):  # near copies
        t = list(base)
        for _ in range(3):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in removed(docs(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)), 100)


def test_no_documents(spark, docs):
    assert removed(docs(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    """Rows with one id, or none, and different texts are documents of their own."""
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(160))
    unique = "".join(chr(65 + (i * 7 + i // 26) % 26) + str(i) for i in range(150))
    rows = [(1, passage), (5, passage + "!"), (5, unique), (None, "no copy"), (None, passage), (5, unique)]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert len(got) == 6 and got[0].asDict().keys() >= {"doc_id", "n_spans", "kept_sha256"}
    assert by == {(None, 7): 0, (None, 160): 0, (1, 160): 160, (5, 161): 160, (5, len(unique)): 0}
