"""Packing along a space-filling curve.

Each document's token ids are hashed into a weighted vector that is projected
to ``DIMS`` dimensions by fixed pseudo-random signs; the normalised coordinates
are quantised and turned into a Hilbert key. Documents are range-sorted by
(key, id) and their tokens, with an end id after each document, are laid end to
end and cut every ``length`` tokens, so only the last sequence of a partition is
short and neighbours on the curve share sequences.

Null and empty texts are one end id. Equal keys are ordered by id, so a large
group of copies spreads over partitions. Repeated rows are packed as they come.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.llm import scratch
from kgivm.llm.kernels import U, mix
from kgivm.llm.pretokens import encoder

LENGTH, DIMS, BITS = 1024, 4, 12


def projection(n_ids: int, dims: int) -> np.ndarray:
    """dims x n_ids weights: a sign from a hash of (id, dimension); rarer (later) vocabulary entries weigh more."""
    ids = np.arange(n_ids, dtype=U)
    signs = np.stack([(mix(ids * U(dims) + U(d) + U(1)) >> U(63)).astype(np.float32) * 2 - 1 for d in range(dims)])
    return signs * np.log2(2 + np.arange(n_ids, dtype=np.float32) / 64)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x dims), after Skilling's transposed form."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of documents given by token ids."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    full = sizes > 0
    at = np.zeros((n, len(weights)))
    norm = np.ones(n)
    if full.any():
        starts = bounds[:-1][full]
        for d, w in enumerate(weights):
            at[full, d] = np.add.reduceat(w[ids], starts)
        norm[full] = np.sqrt(np.add.reduceat(np.square(weights[0][ids]), starts) * np.maximum(1, np.sqrt(sizes[full])))
    unit = 0.5 + 0.5 * np.tanh(at / norm[:, None])
    return hilbert(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def encoded(docs: DataFrame, tokenizer: str, *, style: str, end_id: int, key: str, text: str) -> DataFrame:
    """doc_id, curve, n, ids (little-endian int32) of every document."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        enc = encoder(tokenizer, style)
        weights = projection(enc.lib.get_vocab_size(), DIMS)
        for batch in batches:
            ids_column, text_column = batch.column(0), batch.column(1)
            for lo, hi, ids, bounds in enc.batches(text_column):
                n = hi - lo
                keys = curve_keys(ids, bounds, weights, BITS)
                ends = bounds + np.arange(n + 1)
                out = np.full(ends[-1], end_id, np.int32)
                inner = np.ones(ends[-1], bool)
                inner[ends[1:] - 1] = False
                out[inner] = ids
                narrow = out.astype(np.uint16) if enc.lib.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else out
                size = narrow.itemsize
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(narrow)])
                yield pa.RecordBatch.from_arrays([ids_column.slice(lo, n), pa.array(keys), pa.array(np.diff(ends)), raw], ["doc_id", "curve", "n", "ids"])

    return src.mapInArrow(encode, f"doc_id {kind}, curve long, n long, ids binary")


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id")

    def cut(batches):
        part, base = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            if not len(n):
                continue
            _, offsets, data = batch.column(3).buffers()
            offsets = np.frombuffer(offsets, np.int32)[batch.column(3).offset :][: len(n) + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
            total = int(n.sum())
            ids = raw.view(np.uint16 if len(raw) == 2 * total else np.int32).astype("<u4")
            ends = base + np.concatenate([[0], np.cumsum(n)])
            cuts = np.arange(-(-base // length) * length, ends[-1] + 1, length)
            edges = np.union1d(ends, cuts[(cuts > base) & (cuts < ends[-1])])
            start, size = edges[:-1], np.diff(edges)
            doc = np.searchsorted(ends, start, "right") - 1
            view = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((start - base).tolist(), (start - base + size).tolist())), np.int64, len(start))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start - ends[doc]), pa.array(size), pa.array(crc), pa.array(n[doc]), pa.array(part + start // length), pa.array(start % length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base = int(ends[-1])

    return ordered.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def curve_packing(docs: DataFrame, tokenizer: str, *, style: str = "byte", end_id: int = 0, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Encode, keep the encoded documents in a shared table, range-sort along the curve and pack."""
    return pack(scratch.saved(encoded(docs, tokenizer, style=style, end_id=end_id, key=key, text=text)), length)


def op1_curve_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return curve_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
