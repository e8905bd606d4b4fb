"""Secret scan with a random forest against false positives.

Candidates are long runs of key characters and values assigned to names such as
``password``. Each gets features of its length, character classes and their
transitions, letter-bigram fit, dictionary coverage, the path and the words
beside it. A random forest, trained here from labelled findings, keeps those
with a mean leaf probability of ``threshold`` or more.

Labelled findings are (text, start, end, is_secret) rows; ``labelled_findings``
makes a bounded, seeded set (``TRAINING_ROWS``) of secrets and of their usual
look-alikes (digests of files, identifiers, placeholders, paths, and invented
long words drawn from the dictionary's letter pairs alone).

Null and empty texts have no findings. Positions are code points. Rows are
answered one by one, so repeated rows agree. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.llm.kernels import chunks, runs

TRAINING_ROWS, TREES, DEPTH, THRESHOLD, MIN_RUN = 4000, 40, 9, 0.5, 16
KEY = np.zeros(256, bool)
KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")] = True
ASSIGNED = re.compile(r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}[\"']?([^\s\"',;]{8,})")
ASKS = re.compile(r"(?i)password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private|signing")
BENIGN = re.compile(r"(?i)sha\d*|md5|hash|digest|checksum|commit|revision|uuid|guid|integrity|etag|example|sample|dummy|placeholder|test|fixture|image|base64|version|build|isbn|serial")
RISKY_PATH = re.compile(r"(?i)(?:^|[\s\"'(/])(?:[\w.-]+/)*(?:\.env|config|settings|secrets?|credentials?|deploy|prod)[\w.-]*")
TAME_PATH = re.compile(r"(?i)(?:tests?|examples?|docs?|samples?|fixtures?|mocks?|node_modules|vendor)/")
PREFIXES = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ[A-Za-z0-9_-]+\.|SG\.|npm_|pypi-)")
UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
HEX = re.compile(r"^[0-9a-fA-F]+$")
WORDS = (
    "about access account action address after again agent also another api app application array auth back base bean before between block build byte cache call change char check class clear client clone close code color "
    "column command common component config connect container content context control copy count create current data date debug default delete device digest document down each edit element email enable end entry error event "
    "example execute factory false field file filter find first flag folder font form format from function general get group handler hash have header heading height history home host html http icon image index info "
    "init inner input insert instance internal into item java json just key label language last layout length level library like line link list load local location lock login long main make manager map margin max memory "
    "menu message method mode model module more most mouse move must name native network new next node none normal not null number object offset only open option order other output over package page panel parent parse "
    "password path pattern people place point port position post prefix print private process profile program project property public query random read record region release remove render report request reset resource "
    "response result return root route row rule run sample save scale schema screen script search section secret select send sequence server service session set should show size some sort source space stack start state "
    "static status stop storage store stream string style submit support system table target task template test text than that their them then there thing this thread time timeout title token tool total track transfer "
    "tree true type unique unit update upload user using util validate value version very view virtual visible wait warning was what when where which while widget width will window with word work world write would year your"
).split()
DICTIONARY = frozenset(WORDS)
_bigrams = np.ones((27, 27))
for _w in WORDS:
    for _a, _b in zip(_w, _w[1:]):
        _bigrams[ord(_a) - 97, ord(_b) - 97] += 1
_bigrams = np.log(_bigrams / _bigrams.sum(1, keepdims=True))
CLASS = {**{c: 0 for c in string.digits}, **{c: 1 for c in string.ascii_uppercase}, **{c: 2 for c in string.ascii_lowercase}}
NAMES = (
    "length", "digits", "upper", "lower", "symbols", "transitions", "distinct", "entropy", "bigram", "dictionary", "hex", "run", "prefix", "assigned", "asks", "benign", "risky_path", "tame_path", "uuid", "sequence", "quoted",
)


def coverage(value: str) -> float:
    """Share of the value's letters in dictionary words, longest first from each place."""
    low, at, covered = value.lower(), 0, 0
    letters = sum(c.isalpha() for c in low)
    while at < len(low):
        for n in range(min(11, len(low) - at), 2, -1):
            if low[at : at + n] in DICTIONARY:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / letters if letters else 0.0


def features(value: str, left: str, right: str) -> list[float]:
    n = len(value)
    kinds = [CLASS.get(c, 3) for c in value]
    counts = Counter(value)
    letters = [ord(c) - 97 for c in value.lower() if "a" <= c <= "z"]
    fit = sum(_bigrams[a, b] for a, b in zip(letters, letters[1:])) / max(1, len(letters) - 1)
    longest = run = 1
    steps = 0
    for a, b in zip(value, value[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
        steps += ord(b) - ord(a) == 1
    near, line = left[-32:], left.rpartition("\n")[2]
    return [
        n, *(kinds.count(k) / n for k in range(4)), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), fit, coverage(value), bool(HEX.match(value)), longest / n, bool(PREFIXES.match(value)),
        bool(re.search(r"(?:=>|:=|[:=])\s{0,3}[\"']?$", near)), len(ASKS.findall(near)), len(BENIGN.findall(near + " " + right[:16])), bool(RISKY_PATH.search(line)), bool(TAME_PATH.search(line)),
        bool(UUID.match(value)), steps / max(1, n - 1), left[-1:] in "\"'" and left[-1:] == right[:1] and left != "",
    ]


def candidates(text: str, data: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans of long runs of key characters (dots at their ends do not count), of their long path segments and of whole assigned values; the outer of two comes first."""
    raw = text.encode() if data is None else data.tobytes()
    arr = np.frombuffer(raw, np.uint8)
    found = set()
    start, end = runs(KEY[arr], np.array([0, len(arr)]))
    big = np.flatnonzero(end - start >= MIN_RUN)
    if len(big):
        shift = np.zeros(len(arr) + 1, np.int64)
        np.cumsum((arr & 0xC0) == 0x80, out=shift[1:])
        for a, b in zip((start[big] - shift[start[big]]).tolist(), (end[big] - shift[end[big]]).tolist()):
            while a < b and text[a] in ".=-":
                a += 1
            while a < b and text[b - 1] in ".-":
                b -= 1
            # a name and its value in one run: key=value
            name, _, value = text[a:b].rstrip("=").rpartition("=")
            if name and len(value) >= 8:
                a = b - len(text[a:b]) + len(name) + 1
            if b - a >= 8:
                found.add((a, b))
            # a token may be one segment of a path
            for m in re.finditer(rf"[^/]{{{MIN_RUN},}}", text[a:b]):
                left, right = m.group().lstrip(".=-"), m.group().rstrip(".-")
                if len(left) + len(right) - len(m.group()) >= MIN_RUN:
                    found.add((a + m.end() - len(left), a + m.start() + len(right)))
    if b"=" in raw or b":" in raw:
        for m in ASSIGNED.finditer(text):
            a, b = m.span(1)
            while b - a > 8 and text[b - 1] in ".-":
                b -= 1
            # the parts of a value stay candidates beside the whole, in case that is rejected
            found.add((a, b))
    return sorted(found, key=lambda s: (s[0], -s[1]))


class Forest:
    """A random forest of binary trees with Gini splits, as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = 4, seed: int = 11):
        self.rng, self.least = np.random.default_rng(seed), least
        self.x, self.y = x, y
        self.nodes: list[list[float]] = []
        self.roots = [self._grow(self.rng.integers(0, len(x), len(x)), depth) for _ in range(trees)]
        self.table = np.array(self.nodes)
        del self.x, self.y, self.rng, self.nodes

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        y = self.y[rows]
        here = len(self.nodes)
        self.nodes.append([-1, 0, 0, 0, float(y.mean())])
        if not depth or len(rows) < 2 * self.least or y.min() == y.max():
            return here
        best = (len(rows) * y.mean() * (1 - y.mean()) - 1e-9, None, None)
        for f in self.rng.choice(self.x.shape[1], max(2, int(math.sqrt(self.x.shape[1]))), replace=False):
            v = self.x[rows, f]
            for cut in np.unique(self.rng.choice(v, 12)):
                low = v <= cut
                n = int(low.sum())
                if self.least <= n <= len(rows) - self.least:
                    p, q = y[low].mean(), y[~low].mean()
                    impurity = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
                    if impurity < best[0]:
                        best = (impurity, f, cut)
        if best[1] is not None:
            low = self.x[rows, best[1]] <= best[2]
            left, right = self._grow(rows[low], depth - 1), self._grow(rows[~low], depth - 1)
            self.nodes[here][:4] = [best[1], best[2], left, right]
        return here

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.table[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                go_left = x[inner, f[inner]] <= self.table[at[inner], 1]
                at[inner] = self.table[at[inner], np.where(go_left, 2, 3)].astype(int)
            total += self.table[at, 4]
        return total / len(self.roots)


def labelled_findings(rows: int = TRAINING_ROWS, seed: int = 5) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, is_secret): seeded secrets and look-alikes, in equal parts."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexa, b64, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    follow: dict[str, list[str]] = {}
    for w in WORDS:
        for a, b in zip(w, w[1:]):
            follow.setdefault(a, []).append(b)

    def word(n: int) -> str:
        """An invented word of 2n letters that follow each other as in the dictionary."""
        out = r.choice(WORDS)[0]
        while len(out) < 2 * n:
            out += r.choice(follow.get(out[-1]) or list(follow))
        return out

    prose = lambda: " ".join(r.choice([r.choice(WORDS), word(r.randint(1, 4))]) for _ in range(r.randint(0, 6)))
    secret = [
        lambda: pick(hexa, r.choice([32, 40, 48, 64])), lambda: pick(alnum, r.randint(20, 48)), lambda: pick(b64, r.randint(24, 64)) + r.choice(["", "=", "=="]), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: pick(alnum + "!@#%^*", r.randint(10, 16)),
    ]
    tame = [
        lambda: word(r.randint(6, 14)), lambda: word(r.randint(6, 12)).capitalize(), lambda: "".join(r.choice(WORDS).capitalize() for _ in range(r.randint(3, 6))), lambda: "_".join(r.choice(WORDS) for _ in range(r.randint(3, 6))),
        lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), lambda: r.choice("xX0*-=_.a1") * r.randint(16, 40), lambda: "/".join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + r.choice([".py", ".html", "", ".png"]),
        lambda: "your_" + r.choice(["api_key", "token", "secret", "password"]) + "_here", lambda: pick(string.digits, r.randint(16, 24)), lambda: "www." + word(3) + ".example.com/" + word(3), lambda: "1234567890abcdef1234567890"[: r.randint(16, 26)],
    ]
    names = ["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "API_TOKEN"]
    digests = ["sha256", "md5", "commit", "checksum", "revision", "digest", "sha1", "etag", "integrity"]
    out = []
    for i in range(rows):
        quote = r.choice(['"', "'", ""])
        if i % 2:
            value = r.choice(secret)()
            lead = r.choice([f"{r.choice(names)} = {quote}", f"{r.choice(names)}: {quote}", f"{r.choice(names)}={quote}", f"Bearer {quote}", f"use the {r.choice(names)} {quote}"])
            if PREFIXES.match(value) and r.random() < 0.4:
                lead = quote
            path = r.choice(["", "", "config/prod.env ", "deploy/settings.py: "])
        elif r.random() < 0.35:
            value = pick(hexa, r.choice([32, 40, 64]))
            lead = r.choice([f"{r.choice(digests)} {quote}", f"{r.choice(digests)}: {quote}", f"{r.choice(digests)} = {quote}"])
            path = r.choice(["", "", "tests/data/files.txt: ", "docs/history.md "])
        else:
            value = r.choice(tame)()
            lead = r.choice([quote, quote, quote, f"{r.choice(WORDS)} = {quote}", f"{r.choice(WORDS)}: {quote}", f"{r.choice(names)} = {quote}" if r.random() < 0.4 else quote])
            path = r.choice(["", "", "", "tests/sample.py ", "src/main.c: "])
        text = f"{prose()} {path}{lead}"
        out.append((f"{text}{value}{quote} {prose()}", len(text), len(text) + len(value), bool(i % 2)))
    return out


def vectors(findings: list[tuple[str, int, int]]) -> np.ndarray:
    return np.array([features(t[a:b], t[max(0, a - 64) : a], t[b : b + 24]) for t, a, b, *_ in findings], float).reshape(len(findings), len(NAMES))


def train(findings: list[tuple[str, int, int, bool]]) -> Forest:
    return Forest(vectors(findings), np.array([f[3] for f in findings], float))


def scan(docs: DataFrame, forest: Forest, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, n_candidates, n_secrets, spans (start:end, comma-joined), best (highest probability; null without candidates) of every row."""
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            rows, spans = [], []
            for lo, hi, data, at in chunks(batch.column(1)):
                long_run = np.zeros(hi - lo, bool)
                start, end = runs(KEY[data], at)
                big = start[end - start >= MIN_RUN]
                long_run[np.searchsorted(at, big, "right") - 1] = True
                assigned = np.zeros(hi - lo, bool)
                assigned[np.searchsorted(at, np.flatnonzero((data == 61) | (data == 58)), "right") - 1] = True
                for i in np.flatnonzero(long_run | assigned).tolist():
                    part = data[at[i] : at[i + 1]]
                    value = part.tobytes().decode("utf-8", "replace")
                    for a, b in candidates(value, part):
                        rows.append(lo + i)
                        spans.append((value[max(0, a - 64) : b + 24], min(a, 64), min(a, 64) + b - a, a, b))
            score = forest.predict(vectors(spans)) if spans else np.zeros(0)
            n = batch.num_rows
            row = np.array(rows, np.int64)
            good = score >= threshold
            names: list[list[str]] = [[] for _ in range(n)]
            last = (-1, 0)
            for i in np.flatnonzero(good).tolist():
                r, (_, _, _, a, b) = rows[i], spans[i]
                if r == last[0] and a < last[1]:
                    good[i] = False  # a part of a finding
                    continue
                last = (r, b)
                names[r].append(f"{a}:{b}")
            best = np.full(n, -1.0)
            np.maximum.at(best, row, score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[good], minlength=n)), pa.array([",".join(x) for x in names], pa.string()), pa.array(best, mask=best < 0)],
                ["k", "n_candidates", "n_secrets", "spans", "best"],
            )

    return src.mapInArrow(find, f"k {kind}, n_candidates long, n_secrets long, spans string, best double").withColumnRenamed("k", key)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_findings()))
