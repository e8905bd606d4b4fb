"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four patterns and their checks. Looser candidates (digit
groups, spelled-out addresses) are voted on by regex, gazetteer and context
labelers. Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability; the posteriors train a logistic span classifier,
whose weights become a column expression. Candidates that it accepts with
``min_probability``, that no labeler voted against, and that overlap no base
span, are added; base spans always stay.

Vote patterns are counted over all documents; there are at most 3 ** 8 of them
times 40 shapes, whatever the input, and only these counts reach the driver.

Null and empty texts have no spans. Each row is answered by itself, so repeated
rows agree. Positions are code points. Extra columns are ignored by ``find``
and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgivm.llm import scratch

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that each text position is tried once: a match can only start where a run starts or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NUMBER = r"(?:(?<![0-9A-Za-z+])|\G)\+?\(?[0-9][0-9().\x20-]{5,28}[0-9](?![0-9A-Za-z])"
SPELLED = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]++)++"
ASKING = r"(?i)\b(phone|telephone|tel|call|fax|mobile|cell|contact|whatsapp|email|e-mail|mail|reach)\b"
PAYING = r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment)\b"
OTHERWISE = r"(?i)\b(version|release|isbn|issn|doi|page|pages|section|chapter|figure|table|id|order|invoice|build|token|key|hash|year|total)\b"
TOP_LEVEL = r"(?i)\.(com|net|org|edu|gov|io|info|de|fr|es|uk)$"
LABELERS = ("base", "grouped", "checksum", "asking", "paying", "otherwise", "dated", "domain")
MIN_PROBABILITY = 0.9


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<s, e, m, left, right>> of the matches, in linear time: pieces between matches give the positions."""
    kind = "array<struct<s:int,e:int,m:string,left:string,right:string>>"
    nothing = F.array().cast(kind)

    def place(x: Column) -> Column:
        n = F.size(x["m"])
        every = F.sequence(F.lit(0), n - 1)
        add = lambda a, b: a + b
        # prefix sums in blocks of 64, so many matches in one text stay cheap
        sizes = F.transform(every, lambda i: F.length(F.get(x["g"], i)) + F.length(F.get(x["m"], i)))

        def with_sizes(size: Column) -> Column:
            heads = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda b: F.aggregate(F.slice(size, 1, b * 64), F.lit(0), add))

            def with_heads(head: Column) -> Column:
                block = lambda i: F.floor(i / 64).cast("int")
                end = lambda i: F.get(head, block(i)) + F.aggregate(F.slice(size, block(i) * 64 + 1, i % 64 + 1), F.lit(0), add)
                return F.transform(every, lambda i: let(end(i), lambda e: F.struct(
                    (e - F.length(F.get(x["m"], i))).alias("s"), e.alias("e"), F.get(x["m"], i).alias("m"),
                    F.right(F.get(x["g"], i), F.lit(40)).alias("left"), F.left(F.get(x["g"], i + 1), F.lit(40)).alias("right"),
                )))

            return let(heads, with_heads)

        return F.when(n == 0, nothing).otherwise(let(sizes, with_sizes))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.when(gate, let(both, place)).otherwise(nothing)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        # leading zeros do not count: a part is too large when, without them, it is long or over 255
        part = lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.left(q, F.lit(3)).cast("int") <= 255))
        return F.forall(F.split(m, "[.]"), part)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), F.call_function("luhn_check", digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_columns(text: Column) -> dict[str, Column]:
    """Per kind the valid base matches."""
    gates = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"\+[0-9]")}
    keep = lambda kind: F.filter(matches(text, PATTERNS[kind], gates[kind]), lambda x: valid(kind, x["m"]))
    return {kind: keep(kind) for kind in KINDS}


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def judged(candidates: Column, spelled: bool, base: list[Column]) -> Column:
    """Candidates with votes, shape features and the kind they would get."""

    def one(c: Column) -> Column:
        m, n = c["m"], F.length(digits(c["m"]))
        on_base = F.lit(False)
        for spans in base:
            on_base = on_base | F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        near = F.concat_ws(" ", F.right(c["left"], F.lit(24)), F.left(c["right"], F.lit(12)))
        card = (n >= 13) & (n <= 19)
        if spelled:
            votes = [vote(on_base), vote(F.lit(True)), F.lit(0), vote(near.rlike(ASKING)), F.lit(0), vote(F.lit(False), near.rlike(OTHERWISE)), F.lit(0), vote(m.rlike(TOP_LEVEL))]
            kind, shape = F.lit("email"), F.lit(0)
        else:
            votes = [
                vote(on_base), vote(m.rlike(r"^\+?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}$"), ~m.rlike("[ ().-]")), vote(card & F.call_function("luhn_check", digits(m)), card),
                vote(near.rlike(ASKING)), vote(near.rlike(PAYING) & card), vote(F.lit(False), near.rlike(OTHERWISE)),
                vote(F.lit(False), m.rlike(r"^(?:[12][0-9]{3}[-. ][01]?[0-9][-. ][0-3]?[0-9]|[0-3]?[0-9][-. ][01]?[0-9][-. ][12][0-9]{3})$|^[0-9]+\.[0-9]+$")), F.lit(0),
            ]
            kind = F.when(card & F.call_function("luhn_check", digits(m)), "card").otherwise("phone")
            shape = F.least(n, F.lit(19)) * 2 + F.when(m.rlike("^[+(]"), 1).otherwise(0)
        return F.struct(kind.alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.array(*votes).alias("votes"), shape.cast("int").alias("shape"), on_base.alias("on_base"))

    return F.transform(candidates, one)


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, base spans per kind and judged candidates of every row, in a shared table: the only pass over the texts."""
    t = F.col("_t")
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    rows = src.select("k", "_t", *(slim(c).alias(f"b_{k}") for k, c in base_columns(t).items()))
    base = [F.col(f"b_{k}") for k in KINDS]
    numbers = judged(matches(t, NUMBER, t.rlike(r"[0-9][0-9().\x20-]{5}")), False, base)
    spelled = judged(matches(t, SPELLED, t.rlike(r"(?i)[(\[{]at[)\]}]")), True, base)
    return scratch.saved(rows.select("k", *base, F.concat(numbers, spelled).alias("cand")))


class Model:
    """Reliabilities of the labelers and the weights of the span classifier."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int, float]], rounds: int = 30):
        """``patterns``: votes, shape, count."""
        self.n = len(LABELERS)
        total = sum(c for _, _, c in patterns)
        self.weights = [0.0] * (2 * self.n + 1)
        self.shapes: dict[int, float] = {}
        self.reliability = {}
        if not total:
            self.weights[-1] = -10.0
            return
        belief = {v: 0.9 if sum(v) > 0 else 0.1 for v, _, _ in patterns}
        counts: dict[tuple[int, ...], float] = {}
        for v, _, c in patterns:
            counts[v] = counts.get(v, 0) + c
        for _ in range(rounds):
            prior = (1 + sum(belief[v] * c for v, c in counts.items())) / (2 + total)
            # a labeler says -1, 0 or 1 with one distribution for each truth; its own direction is a weak prior
            seen = [[[1.0, 2.0, 4.0], [4.0, 2.0, 1.0]] for _ in range(self.n)]
            for v, c in counts.items():
                for j, x in enumerate(v):
                    seen[j][0][x + 1] += belief[v] * c
                    seen[j][1][x + 1] += (1 - belief[v]) * c
            says = [[[x / sum(side) for x in side] for side in s] for s in seen]
            for v in counts:
                odds = math.log(prior / (1 - prior)) + sum(math.log(says[j][0][x + 1] / says[j][1][x + 1]) for j, x in enumerate(v))
                belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        self.reliability = {name: (says[j][0][2], says[j][1][0]) for j, name in enumerate(LABELERS)}
        self._train([(v, s, c / total, belief[v]) for v, s, c in patterns])

    def features(self, votes: tuple[int, ...]) -> list[float]:
        """Votes for and against, without the base patterns' own vote (it would decide alone), and a constant."""
        rest = [0, *votes[1:]]
        return [float(x > 0) for x in rest] + [float(x < 0) for x in rest] + [1.0]

    def _train(self, rows, steps: int = 400, rate: float = 2.0, decay: float = 1e-3) -> None:
        for _ in range(steps):
            grad, by_shape = [decay * w for w in self.weights], {}
            for v, s, c, y in rows:
                f = self.features(v)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.score(f, s)))))
                d = c * (p - y)
                for i, x in enumerate(f):
                    grad[i] += d * x
                by_shape[s] = by_shape.get(s, 0.0) + d
            self.weights = [w - rate * g for w, g in zip(self.weights, grad)]
            for s, d in by_shape.items():
                old = self.shapes.get(s, 0.0)
                self.shapes[s] = old - rate * (d + decay * old)

    def score(self, features: list[float], shape: int) -> float:
        return sum(w * x for w, x in zip(self.weights, features)) + self.shapes.get(shape, 0.0)

    def accepts(self, c: Column, least: float) -> Column:
        """The classifier as a column expression."""
        out = F.lit(self.weights[-1])
        for j in range(1, self.n):
            v = F.get(c["votes"], F.lit(j))
            out = out + F.when(v > 0, self.weights[j]).when(v < 0, self.weights[self.n + j]).otherwise(0.0)
        if self.shapes:
            weight = F.create_map(*(F.lit(x) for pair in sorted(self.shapes.items()) for x in pair))
            out = out + F.coalesce(F.try_element_at(weight, c["shape"]), F.lit(0.0))
        votes = c["votes"]
        against = F.exists(votes, lambda v: v < 0)
        support = F.size(F.filter(F.slice(votes, 2, self.n - 1), lambda v: v > 0))
        return (out >= math.log(least / (1 - least))) & ~against & (support >= 2) & ~c["on_base"]


def fit(scanned: DataFrame) -> Model:
    rows = scanned.select(F.explode("cand").alias("c")).groupBy("c.votes", "c.shape").agg(F.count("*").alias("n"))
    return Model(sorted((tuple(r.votes), r["shape"], float(r.n)) for r in rows.toLocalIterator()))


def spans_of(scanned: DataFrame, model: Model, least: float) -> DataFrame:
    """Adds ``base`` and ``all``: array<struct<o (order of the kind), s, e, kind>>, sorted."""
    tagged = lambda o, c: F.transform(c, lambda x: F.struct(F.lit(o).alias("o"), x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS[o]).alias("kind")))
    order = lambda kind: F.when(kind == "email", 0).when(kind == "card", 2).otherwise(3)
    added = F.transform(F.filter("cand", lambda c: model.accepts(c, least)), lambda c: F.struct(order(c["kind"]).alias("o"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind")))
    rows = scanned.withColumn("base", F.concat(*(tagged(o, F.col(f"b_{k}")) for o, k in enumerate(KINDS))))
    return rows.withColumn("all", F.array_sort(F.concat("base", added)))


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """``key``, counts of base spans per kind, base_sha256, spans, n_added."""
    scanned = scan(docs, key, text)
    rows = spans_of(scanned, fit(scanned), min_probability)
    return rows.select(
        F.col("k").alias(key), *(F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, *, text: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, is replaced, and what reaches beyond it goes with it."""
    key = "_row"
    whole = docs.select(F.struct(*docs.columns).alias(key), F.col(text).alias("_text"))
    scanned = scan(whole, key, "_text")
    rows = spans_of(scanned, fit(scanned), min_probability)
    t = F.col(f"k.{text}")
    by_start = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("r"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        inside = x["s"] < a["at"]
        return F.struct(
            F.greatest(a["at"], -x["r"]).alias("at"),
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("out"),
        )

    clean = F.aggregate(by_start, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    rows = rows.withColumn("_clean", F.when(F.size("all") > 0, clean).otherwise(t))
    return rows.select(*(F.col("_clean").alias(c) if c == text else F.col(f"k.`{c}`") for c in docs.columns))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
