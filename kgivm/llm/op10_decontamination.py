"""Benchmark decontamination with a positional inverted index.

``build_index`` stores the postings of the training texts in shards of whole
documents: for every term (a word's fingerprint) its ascending positions (delta
coded), and the documents' places on the shard's position axis, with one free
position between documents. The index knows nothing of the benchmark or of the
width of its windows, so one index serves every benchmark. ``match`` takes every
window of a benchmark (``width`` consecutive words; shorter items are one
window), starts from the postings of its rarest term over all shards and
intersects with the other terms' lists, adjusted by their offsets, in ascending
order of frequency. ``proximity`` reports items whose terms all lie within
``slop`` words of an occurrence of the rarest one, in any order.

The benchmark is the query set: its windows and terms are held by the driver
and sent to the tasks; a shard decodes the postings of the benchmark's terms
and meets the windows whose rarest term it holds. Null, empty and wordless
texts have no hits (as items: no windows). Repeated rows are answered one by
one; items with equal ids count once per document. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.llm import scratch
from kgivm.llm.kernels import BYTE, LOWER, U, Prints, chunks, per_row, runs, texts

WIDTH = 10
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
SHARD = "docs array<{kind}>, doc_at array<long>, n_words array<long>, terms array<long>, term_ends array<int>, postings binary"


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of some rows and the first word of each row."""
    start, end = runs(WORD[data], at)
    return Prints(BYTE[LOWER[data]]).of(start, end), np.searchsorted(start, at)


class Windows:
    """The windows of a set of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], width: int = WIDTH):
        self.width = width
        data, at = texts(pa.array([t for _, t in items], pa.string()))
        prints, bounds = words(data, at)
        self.vocabulary = np.unique(prints)
        terms = np.searchsorted(self.vocabulary, prints)
        found: dict[tuple[int, ...], set] = {}
        self.items: list[tuple[object, tuple[int, ...]]] = []
        for (item, _), a, b in zip(items, bounds[:-1].tolist(), bounds[1:].tolist()):
            if a < b:
                self.items.append((item, tuple(terms[a:b].tolist())))
            for i in range(a, max(a + 1, b - width + 1) if a < b else a):
                found.setdefault(tuple(terms[i : min(i + width, b)].tolist()), set()).add(item)
        self.owners = [sorted(v, key=str) for v in found.values()]
        self.size = np.array([len(w) for w in found], np.int64)
        self.term = np.full((len(found), width), -1, np.int64)
        for i, w in enumerate(found):
            self.term[i, : len(w)] = w

    def rarest_first(self, frequency: np.ndarray) -> np.ndarray:
        """Word offsets of each window in the order of their terms' frequency."""
        weight = np.where(self.term < 0, np.iinfo(np.int64).max, frequency[self.term])
        return np.argsort(weight, axis=1, kind="stable")


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards with the postings of all terms, written to the shared folder."""

    def index(batches):
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column(1)):
                prints, bounds = words(data, at)
                n = np.diff(bounds)
                doc_at = bounds[:-1] + np.arange(hi - lo)
                order = np.argsort(prints, kind="stable")
                terms = prints[order]
                position = order + np.repeat(np.arange(hi - lo), n)[order]
                starts = np.flatnonzero(np.diff(terms, prepend=~terms[:1]))
                delta = np.diff(position, prepend=0)
                delta[starts] = position[starts]
                small = delta.astype(np.uint16) if len(delta) == 0 or delta.max() < 1 << 16 else delta.astype(np.uint32)
                raw = bytes([small.itemsize]) + small.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in (
                        (batch.column(0).slice(lo, hi - lo).to_pylist(), pa.list_(batch.schema.field(0).type)), (doc_at, pa.list_(pa.int64())), (n, pa.list_(pa.int64())),
                        (terms[starts].view(np.int64), pa.list_(pa.int64())), (np.append(starts[1:], len(terms)) if len(terms) else starts, pa.list_(pa.int32())), (raw, pa.binary()),
                    )], ["docs", "doc_at", "n_words", "terms", "term_ends", "postings"],
                )

    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    shards = src.mapInArrow(index, SHARD.format(kind=src.schema["k"].dataType.simpleString()))
    return scratch.saved(shards, **{"parquet.block.row.count.limit": "32"})  # a reader's batch ends with its row group


def known(terms: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``terms``, places in ``vocabulary``) of the terms in both; both are ascending."""
    if not len(vocabulary) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.searchsorted(vocabulary, terms)
    here = np.flatnonzero(vocabulary[np.minimum(place, len(vocabulary) - 1)] == terms)
    return here, place[here]


def lists(column: pa.Array, i: int, kind: type) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def frequencies(shards: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each benchmark term in all shards (at most one row per term comes back)."""

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                here, place = known(lists(batch.column(0), i, np.int64).view(U), vocabulary)
                total[place] += np.diff(lists(batch.column(1), i, np.int64), prepend=0)[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

    rows = shards.select("terms", "term_ends").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows.toLocalIterator():
        out[r.t] = r.n
    return out


class Shard:
    """One row of the index with the postings of a vocabulary's terms, ready for intersections."""

    def __init__(self, docs, doc_at, n_words, terms, term_ends, postings: bytes, vocabulary: np.ndarray):
        self.docs, self.doc_at, self.n_words = docs, doc_at, n_words
        here, self.terms = known(terms, vocabulary)
        sizes = np.diff(term_ends, prepend=0)[here]
        self.hi = np.cumsum(sizes)
        self.lo = self.hi - sizes
        delta = np.frombuffer(postings, np.uint16 if postings[0] == 2 else np.uint32, offset=1)
        sums = np.cumsum(delta[np.repeat(term_ends[here] - sizes - self.lo, sizes) + np.arange(sizes.sum())], dtype=np.int64)
        before = np.append(0, sums)[self.lo]
        self.position = sums - np.repeat(before, sizes)
        self.key = (np.repeat(self.terms, sizes) << 40) | self.position

    def span(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place in ``position`` of the postings of some terms (none for terms without)."""
        if not len(self.terms):
            return np.zeros(len(term), np.int64), np.zeros(len(term), np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        has = self.terms[at] == term
        return np.where(has, self.lo[at], 0), np.where(has, self.hi[at], 0)

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``term``, position) of all postings of some terms."""
        lo, hi = self.span(term)
        n = hi - lo
        which = np.repeat(np.arange(len(term)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, self.position[lo[which] + inner]

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = (term << 40) | position
        at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        return (self.key[at] == want) & (position >= 0) if len(self.key) else np.zeros(len(want), bool)

    def phrases(self, w: Windows, order: np.ndarray, by_rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of all exact occurrences; ``by_rarest`` lists the windows by their rarest term."""
        rarest = w.term[by_rarest, order[by_rarest, 0]]
        lo, hi = np.searchsorted(rarest, self.terms), np.searchsorted(rarest, self.terms, "right")
        some = by_rarest[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())]
        which, at = self.expand(w.term[some, order[some, 0]])
        which = some[which]
        at = at - order[which, 0]
        for k in range(1, w.width):
            if not len(which):
                break
            off = order[which, k]
            need = k < w.size[which]
            ok = ~need
            ok[need] = self.has(w.term[which[need], off[need]], at[need] + off[need])
            which, at = which[ok], at[ok]
        return which, at

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_at, position, "right") - 1


def shards_of(batches, vocabulary: np.ndarray):
    for batch in batches:
        docs, doc_at, n_words, terms, ends, postings = (batch.column(c) for c in ("docs", "doc_at", "n_words", "terms", "term_ends", "postings"))
        for i in range(batch.num_rows):
            yield Shard(
                docs[i].as_py(), lists(doc_at, i, np.int64), lists(n_words, i, np.int64), lists(terms, i, np.int64).view(U), lists(ends, i, np.int64), postings[i].as_py(), vocabulary
            ), docs.type.value_type


def match(shards: DataFrame, windows: Windows) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every indexed document."""
    order = windows.rarest_first(frequencies(shards, windows.vocabulary))
    by_rarest = np.argsort(windows.term[np.arange(len(order)), order[:, 0]], kind="stable")
    kind = shards.schema["docs"].dataType.elementType.simpleString()
    empty = hashlib.sha256(b"").hexdigest()

    def find(batches):
        for shard, doc_type in shards_of(batches, windows.vocabulary):
            n = len(shard.docs)
            which, at = shard.phrases(windows, order, by_rarest)
            end = int(shard.doc_at[-1] + shard.n_words[-1]) if n else 0
            step = np.zeros(end + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + windows.size[which], -1)
            covered = np.cumsum(step) > 0
            hit = per_row(covered, np.append(shard.doc_at, len(covered)))
            names: list[set] = [set() for _ in range(n)]
            for d, x in np.unique(np.stack([shard.doc_of(at), which]), axis=1).T.tolist() if len(at) else []:
                names[d].update(windows.owners[x])
            items = [sorted(map(str, s)) for s in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.docs, doc_type), pa.array(shard.n_words), pa.array(hit), pa.array([len(i) for i in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() if i else empty for i in items]), pa.array(hit > 0), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    return shards.mapInArrow(find, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def proximity(shards: DataFrame, windows: Windows, slop: int) -> DataFrame:
    """doc_id, item, position (in the document) of occurrences of an item's rarest term that have all its other terms within ``slop`` words."""
    frequency = frequencies(shards, windows.vocabulary)
    kind = shards.schema["docs"].dataType.elementType.simpleString()
    wanted = [(str(item), sorted(set(terms), key=lambda t: (frequency[t], t))) for item, terms in windows.items]

    def near(batches):
        for shard, doc_type in shards_of(batches, windows.vocabulary):
            docs, items, places = [], [], []
            for item, terms in wanted:
                _, at = shard.expand(np.array(terms[:1]))
                for t in terms[1:]:
                    lo, hi = (int(x[0]) for x in shard.span(np.array([t])))
                    own = shard.position[lo:hi]
                    doc = shard.doc_of(at)
                    low = np.maximum(at - slop, shard.doc_at[doc])
                    high = np.minimum(at + slop, shard.doc_at[doc] + shard.n_words[doc] - 1)
                    at = at[np.searchsorted(own, high, "right") > np.searchsorted(own, low)]
                doc = shard.doc_of(at)
                docs += [shard.docs[d] for d in doc.tolist()]
                items += [item] * len(at)
                places += (at - shard.doc_at[doc]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.array(items, pa.string()), pa.array(places, pa.int64())], ["doc_id", "item", "position"])

    return shards.mapInArrow(near, f"doc_id {kind}, item string, position long")


def items_of(benchmark: DataFrame, *, item: str = "item_id", text: str = "text") -> list[tuple[object, str]]:
    """The query set, on the driver."""
    return [(r[0], r[1]) for r in benchmark.select(F.col(item), F.col(text).cast("string")).toLocalIterator() if r[1]]


def decontamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    return match(build_index(docs, key=key, text=text), Windows(items_of(benchmark), width))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit (rows without id stay). The index is deleted once the ids to drop are written."""
    shards = build_index(docs, key=key, text=text)
    gone = scratch.saved(match(shards, Windows(items_of(benchmark), width)).where("contaminated").select(F.col("doc_id").alias("_gone")).distinct())
    scratch.remove(docs.sparkSession, shards)
    return docs.join(gone.hint("merge"), docs[key] == gone["_gone"], "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    got = decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.drop("items")
