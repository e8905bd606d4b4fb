"""Vectors as array columns."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for different lengths, and for a zero vector."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b) + F.lit(1e-10))).otherwise(F.lit(0.0))


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """Signed hashing of words and adjacent word pairs, L2-normalised; a text without words is a zero vector."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    sha = F.transform(F.concat(words, pairs), F.sha1)
    bucket = lambda h: (F.conv(F.left(h, F.lit(8)), 16, 10).cast("long") % dimension).cast("int")
    sign = lambda h: F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    placed = F.transform(sha, lambda h: F.struct(bucket(h).alias("b"), sign(h).alias("s")))
    # one pass over the sorted features instead of a pass for each dimension
    index = F.sequence(F.lit(0), F.lit(dimension - 1))
    summed = F.aggregate(placed, F.create_map().cast("map<int,double>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["b"]), F.create_map(x["b"], F.coalesce(F.try_element_at(m, x["b"]), F.lit(0.0)) + x["s"])))
    dense = F.element_at(F.transform(F.array(summed), lambda m: F.transform(index, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))), 1)
    return F.element_at(F.transform(F.array(dense), lambda v: F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))), 1)), 1)


class _Places(dict):
    """A feature's bucket, doubled, plus 1 for a positive sign; bounded, as texts have ever new features."""

    def __missing__(self, feature: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = hashlib.sha1(feature.encode()).hexdigest()
        place = self[feature] = int(h[:8], 16) % DIMENSION * 2 + int(h[8:10], 16) % 2
        return place


_places = _Places()


def hashed_counts(texts: list[str | None]) -> np.ndarray:
    """``hashed_embedding`` before its normalisation, one row for each text (null: zeros); whole numbers."""
    out = np.zeros((len(texts), DIMENSION))
    for row, text in zip(out, texts):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        if words:
            seen = list(map(_places.__getitem__, words))
            seen += map(_places.__getitem__, map("_".join, zip(words, words[1:])))
            n = np.bincount(seen, minlength=2 * DIMENSION)
            row[:] = n[1::2] - n[::2]
    return out
