"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes when it lies in a string of ``length`` bytes that also starts
earlier (smaller id, or same document and earlier start).

Ranking every byte position would shuffle many times the input, so the ranks
are kept for sampled positions only, without loss: every window of ``length``
bytes picks the smallest fingerprint among its ``seed``-byte substrings, its
anchor. Equal windows have their anchors at equal places, so a window can only
repeat where its anchor's rank does. From there the known prefix grows: a
state is an anchor with an interval of window starts before it, its rank is the
pair (previous rank, fingerprint of the bytes that all those windows share),
and Spark groups the pairs. States whose rank is unique are finished. Of states
with the same whole context, only the first stays; the windows of the others
are repeats. The remaining intervals are cut finer, until they are single
windows and the shared bytes are the window itself.

Fingerprints have 64 bits; equal ones count as equal strings. Null and empty
texts lose nothing. Rows that agree in id and text are one document and agree in
the result. Rows that share an id (or have none) with different texts are
documents of their own, in the order of a hash of their texts. Null ids come
first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgivm.llm import scratch
from kgivm.llm.kernels import BYTE, Prints, U, chunks, mix, texts

LENGTH, SEED = 100, 32
#: Widths of the intervals of window starts in the rounds after the first.
WIDTHS = (23, 6, 1)


def anchors(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """row, anchor (in ``data``), first and last window start, rank, whole-context fingerprint (0: the context leaves the row)."""
    span = length - seed + 1
    size = np.diff(at)
    rows = np.flatnonzero(size >= length)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none, none, none, none
    prints = Prints(BYTE[data])
    gram = prints.grams(seed)
    bits = U(max(1, int(len(gram)).bit_length()))
    low = (gram >> bits << bits) | np.arange(len(gram), dtype=U)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    step = np.zeros(len(data) + 1, np.int8)
    step[at[rows]] += 1
    step[at[rows + 1] - length + 1] -= 1  # a row's last window start and the next row's first are length apart at least
    starts = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8))
    anchor = (low[starts] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, p0, p1 = anchor[first], starts[first], starts[last]
    row = np.searchsorted(at, p0, "right") - 1
    lo, hi = a - span + 1, a + length
    inside = (lo >= at[row]) & (hi <= at[row + 1])
    whole = np.zeros(len(a), U)
    whole[inside] = prints.of(lo[inside], hi[inside])
    return row, a, p0, p1, gram[a].view(np.int64), whole.view(np.int64)


def _seeds(src: DataFrame, length: int, seed: int, only_rank: bool) -> DataFrame:
    """All anchors of a corpus: rank, doc, pos, before (last window start), after (first) as distances from pos, whole."""
    kind = src.schema["doc"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            for lo, _, data, at in chunks(batch.column(1)):
                row, a, p0, p1, rank, whole = anchors(data, at, length, seed)
                if only_rank:
                    yield pa.RecordBatch.from_arrays([pa.array(rank)], ["rank"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rank), batch.column(0).take(pa.array(row + lo)), pa.array(a - at[row]), pa.array((a - p1).astype(np.int32)), pa.array((a - p0).astype(np.int32)), pa.array(whole)],
                        ["rank", "doc", "pos", "near", "far", "whole"],
                    )

    return src.mapInArrow(find, "rank long" if only_rank else f"rank long, doc {kind}, pos long, near int, far int, whole long")


def _contexts(marked: DataFrame, length: int, seed: int, kind: str) -> DataFrame:
    """The bytes around open anchors. ``marked``: text, and per document the list ``open`` of (pos, near, far, rank)."""
    reach = length - seed

    def cut(batches):
        for batch in batches:
            data, at = texts(batch.column(1))
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            if not len(flat):
                continue
            pos, near, far, rank = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            a = at[row] + pos
            lo, hi = np.maximum(at[row], a - reach), np.minimum(at[row + 1], a + length)
            raw = data.tobytes()
            # sums of arrow batches stay small: a context has 2 * length bytes at most
            for i in range(0, len(a), 20_000):
                s = slice(i, i + 20_000)
                ctx = [raw[x:y] for x, y in zip(lo[s].tolist(), hi[s].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[s]), batch.column(0).take(pa.array(row[s])), pa.array(pos[s]), pa.array(near[s]), pa.array(far[s]), pa.array((a - lo)[s].astype(np.int32)), pa.array(ctx, pa.binary())],
                    ["rank", "doc", "pos", "near", "far", "left", "ctx"],
                )

    return marked.mapInArrow(cut, f"rank long, doc {kind}, pos long, near int, far int, left int, ctx binary")


def _later(states: DataFrame, groups: DataFrame, by: list[str], length: int) -> DataFrame:
    """doc, start, end of the windows of all states but the first of each group."""
    many = groups.where("n > 1").select(*by, F.col("first.doc").alias("fd"), F.col("first.pos").alias("fp"))
    again = states.join(many, by).where(~(F.struct("doc", "pos").eqNullSafe(F.struct(F.col("fd").alias("doc"), F.col("fp").alias("pos")))))
    return scratch.saved(again.select("doc", (F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("near") + length).alias("end")))


def _open(groups: DataFrame) -> DataFrame:
    """The first states of groups that share their rank with another group."""
    shared = groups.groupBy("rank").agg(F.count("*").alias("m")).where("m > 1").select("rank")
    return groups.join(shared, "rank", "left_semi")


def _round(states: DataFrame, width: int, was: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Cut each state's interval (``was`` wide, from ``base``) into intervals of ``width``; returns repeated windows and groups."""
    cuts = F.sequence(F.lit(0), F.lit(was - 1), F.lit(width))
    s = states.withColumn("base", F.explode(F.transform(cuts, lambda i: F.col("base") + i)))
    s = s.withColumn("top", F.col("base") + width - 1)
    s = s.withColumn("near", F.greatest("near", "base")).withColumn("far", F.least("far", "top")).where("near <= far")
    # windows start `base` to `top` bytes before pos: what all of them hold, and what any of them holds
    core = F.substring(F.col("ctx"), F.col("left") - F.col("base") + 1, F.lit(length - width + 1))
    begin, size = F.col("left") - F.col("top"), F.lit(length + width - 1)
    full = (begin >= 0) & (begin + size <= F.length("ctx"))
    whole = F.when(full, F.xxhash64(F.substring(F.col("ctx"), begin + 1, size))).otherwise(F.xxhash64("doc", "pos", F.lit("edge")))
    # later rounds need no bytes beyond these, the last one none
    skip = F.greatest(begin, F.lit(0))
    rest = ["doc", "pos", "near", "far"] if width == 1 else ["doc", "pos", "near", "far", (F.col("left") - skip).alias("left"), F.substring(F.col("ctx"), skip + 1, begin + size - skip).alias("ctx")]
    s = s.select(F.xxhash64("rank", "base", core).alias("rank"), whole.alias("whole"), "base", *rest)
    groups = scratch.saved(s.groupBy("rank", "whole", "base").agg(F.min(F.struct(*s.columns[3:])).alias("first"), F.count("*").alias("n")))
    return _later(s, groups, ["rank", "whole", "base"], length), groups


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, text. Where an id stands for several texts, doc is the pair of the id and a hash of the text."""
    src = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    print_ = F.xxhash64("text")
    if src.groupBy("doc").agg(F.min(print_).alias("low"), F.max(print_).alias("high")).where("low <> high").isEmpty():
        return src
    return src.select(F.struct(F.col("doc").alias("id"), print_.alias("print")).alias("doc"), "text")


def repeated_spans(src: DataFrame, *, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc, start, end: byte spans (they may overlap) of windows that also start earlier, of texts with one ``doc`` each."""
    spark = src.sparkSession
    kind = src.schema["doc"].dataType.simpleString()
    twice = _seeds(src, length, seed, True).groupBy("rank").agg(F.count("*").alias("m")).where("m > 1").select("rank")
    found = _seeds(src, length, seed, False).join(twice, "rank", "left_semi")
    found = scratch.saved(found.withColumn("whole", F.when(F.col("whole") == 0, F.xxhash64("doc", "pos", F.lit("edge"))).otherwise(F.col("whole"))))
    groups = scratch.saved(found.groupBy("rank", "whole").agg(F.min(F.struct("doc", "pos", "near", "far")).alias("first"), F.count("*").alias("n")))
    spans = _later(found, groups, ["rank", "whole"], length)
    scratch.remove(spark, found)
    per_doc = _open(groups).select("rank", "first.*").groupBy("doc").agg(F.collect_list(F.struct("pos", "near", "far", "rank")).alias("open"))
    marked = src.join(per_doc.withColumnRenamed("doc", "d").hint("merge"), F.col("doc").eqNullSafe(F.col("d"))).select("doc", "text", "open")
    held = scratch.saved(_contexts(marked, length, seed, kind).withColumn("base", F.lit(0)))
    scratch.remove(spark, groups)
    states, was = held, length - seed + 1
    for width in WIDTHS:
        again, groups = _round(states, width, was, length)
        spans = spans.unionByName(again)
        scratch.remove(spark, held)
        held, was = groups, width
        if width > 1:
            states = _open(groups).select("rank", "base", "first.*")
    scratch.remove(spark, held)
    return spans


def removed(docs: DataFrame, *, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every row."""
    src = _documents(docs, key, text)
    kind = src.schema["doc"].dataType.simpleString()
    spans = scratch.saved(repeated_spans(src, length=length).distinct())
    # neighbouring windows are joined where they were found, before a document's spans meet
    w = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fused = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w))
    fused = fused.groupBy("doc", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    per_doc = fused.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = src.join(per_doc.withColumnRenamed("doc", "d").hint("merge"), F.col("doc").eqNullSafe(F.col("d")), "left").select("doc", "text", "starts", "ends")

    def strip(batches):
        for batch in batches:
            data, at = texts(batch.column(1))
            raw = memoryview(data.tobytes())
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_removed, n_spans, digests, rest = [], [], [], []
            for i in range(batch.num_rows):
                lo, hi = int(at[i]), int(at[i + 1])
                cut = sorted((max(0, a), min(b, hi - lo)) for a, b in zip(starts[i] or [], ends[i] or []) if a < hi - lo)
                pieces, place, gone = [], 0, 0
                for a, b in cut:
                    pieces.append(raw[lo + place : lo + a])
                    gone += b - a
                    place = b
                pieces.append(raw[lo + place : hi])
                whole = b"".join(pieces)
                n_removed.append(gone)
                n_spans.append(len(cut))
                digests.append(hashlib.sha256(whole).hexdigest())
                rest.append(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(rest, pa.binary())],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = joined.mapInArrow(strip, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if kind.startswith("struct<id:") and kind != docs.schema[key].dataType.simpleString():
        out = out.withColumn("doc", F.col("doc.id"))
    return out.withColumnRenamed("doc", key)


def op7_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
