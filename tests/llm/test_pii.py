import hashlib
import random
import re

from pyspark.sql import functions as F

from kgivm.llm.op3_pii import KINDS, LABELERS, Model, find, redact

RAW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".") if p) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(t):
    return [(k, m.start(), m.end()) for k in KINDS for m in RAW[k].finditer(t or "") if good(k, m[0])]


def texts():
    r = random.Random(4)
    parts = ["a@b.c", "x.y+z@m-1.example.com", "@", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "é", "🙂", "a@b.c_d@e.f", "..", " ", ", ", "5", "-", "+49 30 1234567 ", "a@b", "@c.d", "9" * 40]
    out = [None, "", "call me: 415-555-2671 or mail joe (at) site (dot) com", "4111111111111111", "1 " * 3000, "x" * 50000 + "@y.z", "a@b.c " * 300]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(400)]


def test_base_spans_equal_brute_force(spark, docs):
    rows = texts()
    got = {r.doc_id: r for r in find(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        want = brute(t)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS], t
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(line.split(",") if line else []) <= set(spans) and len(spans) == len(want) + got[i].n_added
    assert find(docs(spark, [])).count() == 0


def test_method_adds_supported_spans_only(spark, docs):
    base = [f"write to user{i}@host.example.com or +1 (555) 555-{1000 + i}" for i in range(40)]
    more = [f"phone 415-555-{2000 + i} anytime" for i in range(20)] + [f"version 3.14.{i} of 2021-03-{10 + i % 9}" for i in range(20)]
    rows = base + more + ["nothing here", "order 4155552671"]
    got = {r.doc_id: r.n_added for r in find(docs(spark, rows)).collect()}
    assert all(got[i] == 0 for i in [*range(40), *range(60, 82)])
    assert all(got[i] == 1 for i in range(40, 60))


def test_model_of_nothing_accepts_nothing(spark):
    row = spark.range(1).select(F.struct(F.array(*[F.lit(1)] * 8).alias("votes"), F.lit(0).alias("shape"), F.lit(False).alias("on_base")).alias("c"))
    assert not row.select(Model([]).accepts(F.col("c"), 0.9)).first()[0]


def test_redact(spark, docs):
    frame = docs(spark, ["mail a@b.cd, ip 1.2.3.4!", None, "", "clean", "+4111111111111111 x"])
    out = redact(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(4)] == ["mail [EMAIL], ip [IP]!", None, "", "clean"]
    assert got[0].k == "k" and "4111" not in got[4].text


def test_reliabilities_are_recovered():
    """Simulated votes of labelers with known habits: expectation-maximisation finds them without labels."""
    import numpy as np

    r = np.random.default_rng(8)
    yes = [0.8, 0.6, 0.7, 0.5, 0.9, 0.4, 0.65, 0.55]
    no = [0.7, 0.5, 0.6, 0.8, 0.6, 0.9, 0.5, 0.75]
    truth = r.random(6000) < 0.45
    votes = np.where(truth[:, None], np.where(r.random((6000, 8)) < yes, 1, np.where(r.random((6000, 8)) < 0.5, 0, -1)), np.where(r.random((6000, 8)) < no, -1, np.where(r.random((6000, 8)) < 0.5, 0, 1)))
    patterns = {}
    for v in votes.tolist():
        patterns[tuple(v)] = patterns.get(tuple(v), 0) + 1
    got = Model([(v, 0, float(c)) for v, c in sorted(patterns.items())]).reliability
    for name, a, b in zip(LABELERS, yes, no):
        assert abs(got[name][0] - a) < 0.06 and abs(got[name][1] - b) < 0.06


def test_added_spans_of_planted_variants(spark):
    """Numbers and addresses that no base pattern reads, beside look-alikes: precision and recall of what is added are 0.9 or more, and base spans stay."""
    r = random.Random(4)
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    words = lambda n: " ".join(r.choice("the of and to in that was he for it with as his on".split()) for _ in range(n))
    good = [
        lambda: ("call", f"({r.randrange(2, 10)}{digits(2)}) {r.randrange(2, 10)}{digits(2)}-{digits(4)}"), lambda: ("phone", f"{r.randrange(2, 10)}{digits(2)}-{r.randrange(2, 10)}{digits(2)}-{digits(4)}"),
        lambda: ("reach me at", f"ann{digits(2)} [at] mail{digits(1)} [dot] com"), lambda: ("tel", f"0{digits(2)} {digits(3)} {digits(4)}"),
    ]
    bad = [
        lambda: ("version", f"{digits(3)}.{digits(2)}.{digits(4)}"), lambda: ("order", digits(10)), lambda: ("in the year", f"19{digits(2)}-0{r.randrange(1, 10)}-1{digits(1)}"),
        lambda: ("total", f"{digits(7)}.{digits(2)}"), lambda: ("was", digits(12)), lambda: ("isbn", f"{digits(3)}-{digits(4)}-{digits(5)}"),
    ]
    known = [lambda: ("mail", f"bob{digits(2)}@mail{digits(1)}.example.com"), lambda: ("ring", f"+1 ({digits(3)}) 555-{digits(4)}")]
    rows, planted = [], set()
    for i in range(400):
        text = words(12)
        for make in [*r.sample(good, 1), *r.sample(bad, 2), *r.sample(known, 1)]:
            lead, found = make()
            text += f" {lead} "
            if make in good:
                planted.add((i, len(text), len(text) + len(found)))
            text += f"{found} {words(8)}"
        rows.append((i, text))
    added = set()
    for row in find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = {":".join(map(str, s)) for s in brute(rows[row.doc_id][1])}
        spans = set(row.spans.split(","))
        assert base <= spans and row.n_added == len(spans - base)
        added |= {(row.doc_id, *map(int, s.split(":")[1:])) for s in spans - base}
    right = len(added & planted)
    assert right >= 0.9 * len(planted) and right >= 0.9 * len(added)
