"""All pairs of a query set and rows by cosine, in blocks of vectors.

Rows and queries are packed into blocks of at most ``BLOCK_ROWS`` vectors and
1 MB or so; every block of queries meets every block of rows in a cross join of
blocks, and a pair of blocks is one matrix product. Neither side is collected;
Spark broadcasts the queries only if they are small by its own threshold. The
number of products is the job's (all pairs); what is kept and moved is a few rows
for each query and task.

Products only find candidates: what lies within ``SLACK`` of a decision is scored
again with the sums of ``functions.vectors.cosine``, in their order, so scores and
ranks are those of the column expression. Null vectors and vectors of different
lengths score 0, vectors with a null in them null (last), NaN comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 20
#: Vectors in a partition of one side, at most (but for a last block).
PART_ROWS, PART_QUERIES = 65_536, 16_384
#: Scores nearer than this to a threshold or to a rank are computed again; a matrix product is off by 1e-14 at most, ranks are by nine decimals.
SLACK = 4e-9
#: Candidates that are scored again at once.
CHUNK = 32_768
#: Blocks of queries whose results a task holds before it hands them on.
HELD = 64


@dataclass
class Block:
    ids: pa.Array
    sizes: np.ndarray  # -1 or -2 for a null vector
    holes: np.ndarray  # vectors with a null in them
    data: np.ndarray
    norms: np.ndarray
    more: dict[str, pa.Array]

    @property
    def keys(self) -> np.ndarray:
        return self.ids.to_numpy(zero_copy_only=False)


def matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors padded with 0 to the longest one, their sizes (null: -1), and which have a null in them."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    held, flat = np.maximum(sizes, 0).astype(np.int64), column.flatten()
    row = np.repeat(np.arange(len(sizes)), held)
    place = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    data, holes = np.zeros((len(sizes), int(held.max(initial=0)))), np.zeros(len(sizes), dtype=bool)
    data[row, place] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        holes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return data, sizes, holes


def _norms(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data))
    for x in data.T:
        total += x * x
    return np.sqrt(total)


def _packed(rows: DataFrame, key: str, column: str, more: list[str], prefix: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [key, *more]

    def pack(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                longest = batch.column(column).slice(at, BLOCK_ROWS).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=1)
                part = batch.slice(at, max(16, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, int(longest))))))
                at += part.num_rows
                data, sizes, holes = matrix(part.column(column))
                one = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*one, *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, holes, data))], fields)

    fields = [prefix + c for c in (*names, "sizes", "holes", "data")]
    lists = ", ".join(f"`{prefix}{c}` array<{kinds[c]}>" for c in names)
    out = rows.select(*names, column).mapInArrow(pack, f"{lists}, {prefix}sizes binary, {prefix}holes binary, {prefix}data binary")
    return out.withColumn(f"{prefix}number", F.monotonically_increasing_id())


def _unpacked(batch: pa.RecordBatch, at: int, key: str, more: list[str], prefix: str) -> Block:
    sizes, holes, data = (np.frombuffer(batch.column(prefix + c)[at].as_buffer(), t) for c, t in (("sizes", np.int32), ("holes", bool), ("data", np.float64)))
    data = data.reshape(len(sizes), -1)
    return Block(batch.column(prefix + key)[at].values, sizes, holes, data, _norms(data), {c: batch.column(prefix + c)[at].values for c in more})


def cells(rows: DataFrame, queries: DataFrame, *, key: str, column: str, more: tuple[str, ...] = (), asked: tuple[str, ...] = ()) -> DataFrame:
    """Every block of ``rows`` (``key``, ``column``, ``more``) beside every block of ``queries`` (query_id, query_vector, ``asked``)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n, m = rows.count(), queries.count()
    left = _packed(queries, "query_id", "query_vector", list(asked), "q_").repartition(-(-m // PART_QUERIES) or 1)
    right = _packed(rows, key, column, list(more), "r_").repartition(max(cores, -(-n // PART_ROWS)))
    return left.crossJoin(right)


def met(key: str, more: tuple[str, ...], asked: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, Block]]:
    """The number of the block of queries, its block, and a block of rows, for each row of ``cells``."""
    last = [None, None, None, None]
    for batch in batches:
        for at in range(batch.num_rows):
            numbers = [batch.column(f"{p}_number")[at].as_py() for p in "qr"]
            if numbers[0] != last[0]:
                last[:2] = numbers[0], _unpacked(batch, at, "query_id", list(asked), "q_")
            if numbers[1] != last[2]:
                last[2:] = numbers[1], _unpacked(batch, at, key, list(more), "r_")
            yield last[0], last[1], last[3]


def products(q: Block, r: Block) -> np.ndarray:
    """Cosines to 1e-14; null: -inf, NaN: inf."""
    m = min(q.data.shape[1], r.data.shape[1])
    with np.errstate(all="ignore"):
        out = q.data[:, :m] @ r.data[:, :m].T
        out /= np.outer(q.norms, r.norms) + 1e-10
    return _odd(out, q.sizes[:, None], r.sizes[None, :], q.holes[:, None], r.holes[None, :])


def exactly(q: Block, r: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of some pairs, summed in the order of the vectors; null: -inf, NaN: inf."""
    m, out = min(q.data.shape[1], r.data.shape[1]), np.zeros(len(i))
    for at in range(0, len(i), CHUNK):
        a, b = i[at : at + CHUNK], j[at : at + CHUNK]
        x, y, total = q.data[a], r.data[b], np.zeros(len(a))
        with np.errstate(all="ignore"):
            for d in range(m):
                total += x[:, d] * y[:, d]
            total /= q.norms[a] * r.norms[b] + 1e-10
        out[at : at + CHUNK] = _odd(total, q.sizes[a], r.sizes[b], q.holes[a], r.holes[b])
    return out


def _odd(score: np.ndarray, q_size: np.ndarray, r_size: np.ndarray, q_hole: np.ndarray, r_hole: np.ndarray) -> np.ndarray:
    if np.isnan(score.sum()):
        score[np.isnan(score)] = np.inf
    if q_hole.any() or r_hole.any():
        score[q_hole | r_hole] = -np.inf
    if q_size.min() < 0 or len(np.union1d(q_size, r_size)) > 1:
        score[(q_size != r_size) | (q_size < 0)] = 0.0
    return score


def _rounded(score: np.ndarray, digits: int | None) -> np.ndarray:
    if digits is None:
        return score
    return np.copysign(np.floor(np.abs(score) * 10**digits + 0.5), score) / 10**digits


def _itself(q: Block, r: Block) -> np.ndarray | None:
    """Pairs of a row with itself, where there are any."""
    same = np.isin(q.keys, r.keys)
    return q.keys[:, None] == r.keys[None, :] if same.any() else None


def _run(df: DataFrame, step: Callable, schema: str, key: str, more: tuple[str, ...], asked: tuple[str, ...], handed: Callable) -> DataFrame:
    """``step(state, q, r)`` for each pair of blocks, with the state of the block of queries; ``handed(q, state)`` makes its record batch."""

    def task(batches):
        states: dict[int, list] = {}
        for number, q, r in met(key, more, asked, batches):
            if number not in states and len(states) == HELD:
                yield from (handed(*x) for x in states.values())
                states.clear()
            held = states.setdefault(number, [q, None])
            held[1] = step(held[1], q, r)
        yield from (handed(*x) for x in states.values())

    return df.mapInArrow(task, schema)


def best(
    rows: DataFrame, queries: DataFrame, *, key: str, column: str = "embedding", limit: int, digits: int | None = None, itself: bool = True, threshold: float | None = None,
    allowed: Callable[[Block, Block], np.ndarray | None] | None = None, more: tuple[str, ...] = (), asked: tuple[str, ...] = (),
) -> DataFrame:
    """query_id, ``key`` (a whole number), score: for each query and task the ``limit`` best rows by score (rounded to ``digits``), then by ``key``. ``allowed`` says which pairs of two blocks count."""

    def step(state, q, r):
        if state is None:
            state = np.full((len(q.ids), limit), -np.inf), np.zeros((len(q.ids), limit), dtype=np.int64), np.zeros((len(q.ids), limit), dtype=bool)
        scores, keys, there = state
        ok = allowed(q, r) if allowed else None
        if ok is not None and not ok.any():
            return state
        s = products(q, r)
        if not itself and (same := _itself(q, r)) is not None:
            ok = ~same if ok is None else ok & ~same
        enough = there[:, -1]
        least = np.where(enough, _rounded(scores[:, -1], digits), -np.inf)
        if not enough.all() and s.shape[1] > limit:
            few = np.nonzero(~enough)[0]
            seen = s[few] if ok is None else np.where(ok[few], s[few], -np.inf)
            least[few] = np.maximum(least[few], np.partition(seen, s.shape[1] - limit, axis=1)[:, s.shape[1] - limit])
        if threshold is not None:
            least = np.maximum(least, threshold)
        near = s >= (least - SLACK)[:, None]
        i, j = np.nonzero(near if ok is None else near & ok)
        if not len(i):
            return state
        score, r_keys = exactly(q, r, i, j), r.keys
        if threshold is not None:
            kept = score >= threshold
            i, j, score = i[kept], j[kept], score[kept]
        touched = np.unique(i)
        old = np.nonzero(there[touched])
        i, score, key_of = np.concatenate([i, touched[old[0]]]), np.concatenate([score, scores[touched][old]]), np.concatenate([r_keys[j], keys[touched][old]])
        order = np.lexsort((key_of, -_rounded(score, digits), i))
        i, score, key_of = i[order], score[order], key_of[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < limit
        scores[touched], there[touched] = -np.inf, False
        scores[i[kept], place[kept]], keys[i[kept], place[kept]], there[i[kept], place[kept]] = score[kept], key_of[kept], True
        return state

    def handed(q, state):
        scores, keys, there = state
        i, j = np.nonzero(there)
        score = scores[i, j]
        found = pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)
        return pa.RecordBatch.from_arrays([q.ids.take(pa.array(i)), pa.array(keys[i, j]), found], ["query_id", key, "score"])

    kind = queries.schema["query_id"].dataType.simpleString()
    rows = rows.withColumn(key, F.col(key).cast("long"))
    return _run(cells(rows, queries, key=key, column=column, more=more, asked=asked), step, f"query_id {kind}, `{key}` long, score double", key, more, asked, handed)


def _relevant(q: Block, r: Block) -> tuple[np.ndarray, np.ndarray | None]:
    """Pairs of one label, and those where it is known (None: all)."""
    a, b = q.more["want"], r.more["label"]
    same = a.fill_null(0).to_numpy(zero_copy_only=False)[:, None] == b.fill_null(0).to_numpy(zero_copy_only=False)[None, :]
    if not (a.null_count or b.null_count):
        return same, None
    known = a.is_valid().to_numpy(zero_copy_only=False)[:, None] & b.is_valid().to_numpy(zero_copy_only=False)[None, :]
    return same & known, known


def first_relevant(rows: DataFrame, queries: DataFrame, *, key: str, column: str = "embedding", digits: int, pin: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, rank of its first row of the same label among all other rows (null: there is none), by score (rounded), then by ``key``.

    ``rows``: ``key``, ``column``, label; ``queries``: query_id, query_vector,
    want (whole numbers). One round finds each query's best row of its label,
    another counts the rows before it.
    """

    def nearest(state, q, r):
        if state is None:
            state = np.full(len(q.ids), -np.inf), np.zeros(len(q.ids), dtype=np.int64), np.zeros(len(q.ids), dtype=bool), np.zeros(len(q.ids), dtype=bool)
        score, keys, there, met_any = state
        (hit, _), same = _relevant(q, r), _itself(q, r)
        met_any |= True if same is None else (~same).any(axis=1)
        hit = hit if same is None else hit & ~same
        if not hit.any():
            return state
        s = products(q, r)
        least = np.maximum(np.where(hit, s, -np.inf).max(axis=1), np.where(there, score, -np.inf)) - SLACK
        i, j = np.nonzero(hit & (s >= least[:, None]))
        found, r_keys = _rounded(exactly(q, r, i, j), digits), r.keys
        order = np.lexsort((r_keys[j], -found, i))
        one, at = np.unique(i[order], return_index=True)
        found, of = found[order][at], r_keys[j[order][at]]
        wins = ~there[one] | (found > score[one]) | ((found == score[one]) & (of < keys[one]))
        score[one[wins]], keys[one[wins]], there[one[wins]] = found[wins], of[wins], True
        return state

    def handed(q, state):
        score, keys, there, met_any = state
        return pa.RecordBatch.from_arrays([q.ids.filter(pa.array(met_any)), pa.array(-score, mask=~there).filter(pa.array(met_any)), pa.array(keys, mask=~there).filter(pa.array(met_any))], ["query_id", "low", "key"])

    kind = queries.schema["query_id"].dataType.simpleString()
    rows = rows.withColumn(key, F.col(key).cast("long"))
    got = _run(cells(rows, queries, key=key, column=column, more=("label",), asked=("want",)), nearest, f"query_id {kind}, low double, key long", key, ("label",), ("want",), handed)
    got = pin(got.groupBy("query_id").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("low", "key"))).alias("best")))

    def before(count, q, r):
        count = np.zeros(len(q.ids), dtype=np.int64) if count is None else count
        s, same = products(q, r), _itself(q, r)
        score, keys, r_keys = -q.more["low"].to_numpy(zero_copy_only=False), q.more["best_key"].to_numpy(zero_copy_only=False), r.keys
        more, near = s > (score + SLACK)[:, None], (s >= (score - SLACK)[:, None]) & (s <= (score + SLACK)[:, None])
        if same is not None:
            more, near = more & ~same, near & ~same
        count += more.sum(axis=1)
        i, j = np.nonzero(near)
        found = _rounded(exactly(q, r, i, j), digits)
        ahead = (found > score[i]) | ((found == score[i]) & (r_keys[j] < keys[i]))
        count += np.bincount(i[ahead], minlength=len(count))
        return count

    again = queries.join(got.where("best is not null").select("query_id", "best.low", F.col("best.key").alias("best_key")), "query_id")
    counted = _run(
        cells(rows, again, key=key, column=column, asked=("low", "best_key")), before, f"query_id {kind}, n long", key, (), ("low", "best_key"),
        lambda q, n: pa.RecordBatch.from_arrays([q.ids, pa.array(n)], ["query_id", "n"]),
    )
    return got.select("query_id").join(counted.groupBy("query_id").agg((F.sum("n") + 1).alias("rank")), "query_id", "left")


def threshold_counts(rows: DataFrame, queries: DataFrame, thresholds: list[float], *, key: str, column: str = "embedding") -> DataFrame:
    """threshold, tp, fp, fn, tn over all pairs of a query and another row, with what ``first_relevant`` takes; pairs without a known label are left out."""

    def sums(batches):
        total = np.zeros((len(thresholds), 4), dtype=np.int64)
        for _, q, r in met(key, ("label",), ("want",), batches):
            s, (hit, known), same = products(q, r), _relevant(q, r), _itself(q, r)
            if same is not None:
                known = ~same if known is None else known & ~same
                hit = hit & ~same
            n, relevant = s.size if known is None else np.count_nonzero(known), np.count_nonzero(hit)
            for k, t in enumerate(thresholds):
                over = s >= t
                i, j = np.nonzero(np.abs(s - t) <= SLACK)
                over[i, j] = exactly(q, r, i, j) >= t
                tp = np.count_nonzero(over & hit)
                all_over = np.count_nonzero(over if known is None else over & known)
                total[k] += tp, all_over - tp, relevant - tp, n - relevant - (all_over - tp)
        yield pa.RecordBatch.from_arrays([pa.array(thresholds, pa.float64()), *(pa.array(x) for x in total.T)], ["threshold", "tp", "fp", "fn", "tn"])

    rows = rows.withColumn(key, F.col(key).cast("long"))
    got = cells(rows, queries, key=key, column=column, more=("label",), asked=("want",)).mapInArrow(sums, "threshold double, tp long, fp long, fn long, tn long")
    return got.groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).where("tp + fp + fn + tn > 0")
