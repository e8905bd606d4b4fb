"""Quality rules with suffix-array repetition.

Plain counts (words, symbols, repeated lines, words in repeated 3-word windows)
and, per document, the suffix array of its words: positions are ranked by prefix
doubling from single words, those whose 3-word window occurs again are sorted,
and the longest common prefixes of neighbours in that order give every maximal
repeat. The spans of
repeats of at least ``min_words`` words are united; a document is rejected when
they cover more than ``max_covered`` percent of its words, or when the longest
repeat alone is more than ``max_longest`` percent of them.

Null and empty texts have no words and fail the base rule. Rows are judged one
by one, so repeated rows and copies get equal verdicts. Extra columns are
ignored by ``quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.llm.kernels import BYTE, SPACE, Prints, U, chunks, mix, per_row, runs

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW, MIN_WORDS, MAX_COVERED, MAX_LONGEST = 3, 10, 30, 30
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def duplicate_lines(data: np.ndarray, at: np.ndarray, inside: np.ndarray, prints: Prints) -> np.ndarray:
    """Per row, lines with a word that equal an earlier line of the row."""
    n = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(at[:-1], breaks + 1)
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(n, np.int64)
    row = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], at[row + 1])
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words[1:])
    full = words[end] > words[start]
    start, end, row = start[full], end[full], row[full]
    key = prints.of(start, end) ^ mix(row.astype(U) + U(1))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return np.bincount(row[again], minlength=n)


def repeats(word: np.ndarray, row: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: words in 3-word windows found twice, words in maximal repeats of min_words or more, length of the longest of these.

    ``word``: fingerprints; ``row``: their rows; ``bounds``: first word of each row.
    """
    n, rows = len(word), len(bounds) - 1
    nothing = np.zeros(rows, np.int64)
    if n < WINDOW:
        return nothing, nothing, nothing
    valid = np.flatnonzero(row[:-2] == row[2:])
    if not len(valid):
        return nothing, nothing, nothing
    grams = Prints(word).grams(WINDOW)[valid] ^ mix(row[valid].astype(U) + U(1))
    _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
    live = valid[count[back] > 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, live, 1)
    np.add.at(step, live + WINDOW, -1)
    repeated = per_row(np.cumsum(step[:n]) > 0, bounds)
    if not len(live):
        return repeated, nothing, nothing
    # suffix order by prefix doubling from single words: a rank is the first place of its equals, so ranks keep the order and only equals are ranked again
    first, last = live, bounds[row + 1]
    order = np.lexsort((word, row))
    head = np.append(True, (word[order[1:]] != word[order[:-1]]) | (row[order[1:]] != row[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, size = [], 1
    while True:
        live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(live):
            break
        levels.append((rank, size))
        after = live + size
        follow = np.where(after < last[live], rank[np.minimum(after, n - 1)] + 1, 0)  # the row's end comes first
        order = np.lexsort((follow, rank[live]))
        old, follow, at = rank[live[order]], follow[order], np.arange(len(live))
        new_old = np.append(True, old[1:] != old[:-1])
        new = new_old | np.append(True, follow[1:] != follow[:-1])
        rank = rank.copy()
        rank[live[order]] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
        size *= 2
    order = first[np.argsort(rank[first])]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    # equal ranks are of one row, as its end is a symbol of its own
    for level, size in reversed(levels):
        x, y = a + common, b + common
        ok = (x < n) & (y < n)
        ok &= level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)]
        common += np.where(ok, size, 0)
    longest = np.zeros(len(order), np.int64)
    longest[1:] = common
    longest[:-1] = np.maximum(longest[:-1], common)
    big = longest >= min_words
    step[:] = 0
    np.add.at(step, order[big], 1)
    np.add.at(step, order[big] + longest[big], -1)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[order[big]], longest[big])
    return repeated, per_row(np.cumsum(step[:n]) > 0, bounds), most


def measure(data: np.ndarray, at: np.ndarray, min_words: int) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat of some rows."""
    inside = ~SPACE[data]
    start, end = runs(inside, at)
    bounds = np.searchsorted(start, at)
    prints = Prints(BYTE[data])
    row = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    return [
        np.diff(bounds), per_row(inside & ((data & 0xC0) != 0x80), at), per_row(SYMBOLS[data], at), duplicate_lines(data, at, inside, prints),
        *repeats(prints.of(start, end), row, bounds, min_words),
    ]


def quality(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, carry: bool = False
) -> DataFrame:
    """The measures and the verdict for every row; with ``carry`` all columns of ``docs`` stay in a struct ``row``."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def judge(batches):
        for batch in batches:
            parts = []
            for _, _, data, at in chunks(batch.column(1)):
                m = measure(data, at, min_words)
                words, covered, longest = m[0], m[5], m[6]
                failed = (words < 50) | (100 * m[4] > 50 * words)
                kept = ~failed & (100 * covered <= max_covered * words) & (100 * longest <= max_longest * words)
                parts.append([*m, failed, kept])
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 7 + [np.zeros(0, bool)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["k", *names])

    src = docs.select((F.struct("*") if carry else F.col(key)).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(judge, f"k {kind}, {COLUMNS}").withColumnRenamed("k", "row" if carry else key)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass."""
    return quality(docs, carry=True, **options).where("kept").select("row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
