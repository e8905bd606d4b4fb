"""Matching relation labels to the labels of a graph."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgivm.functions import text as tx
from kgivm.functions import vectors as vx
from kgivm.operators import provenance as pv
from kgivm.store import Graph

THRESHOLD = 0.82
# Label spellings and what they stand for.
ALIASES = {
    "birthplace": "place of birth",
    "born in": "place of birth",
    "born at": "place of birth",
    "date born": "date of birth",
    "birth date": "date of birth",
    "citizen of": "country of citizenship",
    "citizenship": "country of citizenship",
    "nationality": "country of citizenship",
    "located in": "located in the administrative territorial entity",
    "held in": "location",
    "host city": "location",
    "coach of": "coach",
    "head coach of": "coach",
    "coached": "coach",
    "became coach of": "coach",
    "became the coach of": "coach",
    "became coach in": "start time",
    "became the coach in": "start time",
}


def labels(g: Graph) -> DataFrame:
    """position, label: the distinct labels of relations that are not removed, in order."""
    found = g["relations"].where(pv.not_removed()).select(F.col("rel_type").alias("label")).where(tx.strip(F.col("label")) != "").distinct()
    return found.select((F.row_number().over(Window.orderBy("label")) - 1).alias("position"), "label")


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


similarity = F.pandas_udf(_similarity, T.DoubleType())


def match(sources: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, use_embeddings: bool = False) -> DataFrame:
    """source, canonical, method, confidence, status for every distinct ``source`` label.

    By alias, then equal normalised label, then the best lexical score, then (if
    asked for) a strictly better cosine. Of equal scores the first candidate
    wins. ``candidates`` (position, label) is the ontology of a graph, sent to
    all tasks; labels are compared once per distinct pair.
    """
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    src = sources.select("source").distinct().withColumn("norm", tx.normalize_name(F.col("source"))).withColumn("source_text", tx.strip(F.col("source")))
    cand = candidates.select("position", tx.strip(F.col("label")).alias("label")).where("label <> ''").withColumn("cand_norm", tx.normalize_name(F.col("label")))
    cand = pv.first_per(cand, ["cand_norm"], F.col("position"))
    pairs = src.where(~F.array_contains(F.map_keys(alias), F.col("norm"))).crossJoin(F.broadcast(cand))
    scored = pairs.withColumn("lexical", similarity("norm", "cand_norm"))
    best = scored.groupBy("source").agg(
        F.min(F.when(F.col("norm") == F.col("cand_norm"), F.struct("position", "label"))).alias("exact"), F.max(F.struct("lexical", (-F.col("position")).alias("p"), "label")).alias("lex"),
        *([F.max(F.struct(vx.cosine(vx.hashed_embedding(F.col("source_text")), vx.hashed_embedding(F.col("label"))).alias("score"), (-F.col("position")).alias("p"), "label")).alias("emb")] if use_embeddings else []),
    )
    rows = src.join(best, "source", "left").withColumn("alias", F.try_element_at(alias, F.col("norm")))
    emb = F.coalesce(F.col("emb.score") > F.col("lex.lexical"), F.lit(False)) if use_embeddings else F.lit(False)
    score = F.when(emb, F.col("emb.score") if use_embeddings else F.lit(0.0)).otherwise(F.coalesce("lex.lexical", F.lit(0.0)))
    label = F.when(emb, F.col("emb.label") if use_embeddings else F.lit("")).otherwise(F.col("lex.label"))
    sure = F.col("alias").isNotNull() | F.col("exact").isNotNull()
    accepted = sure | (F.col("lex").isNotNull() & (score >= threshold))
    return rows.select(
        "source", F.coalesce("alias", "exact.label", F.when(accepted, label), F.col("source_text")).alias("canonical"),
        F.when(F.col("alias").isNotNull(), "alias").when(F.col("exact").isNotNull(), "exact").when(emb, "embedding").when(F.col("lex").isNotNull(), "lexical").otherwise("none").alias("method"),
        F.when(sure, 1.0).otherwise(score).alias("confidence"), F.when(accepted, "accepted").otherwise("unresolved").alias("status"),
    )


def canonicalize(rows: DataFrame, candidates: DataFrame, *, key: str, column: str = "triples", threshold: float = THRESHOLD, use_embeddings: bool = False) -> DataFrame:
    """``rows`` with the labels of an array of triples made canonical, blank triples gone, repeats after the first gone."""
    each = rows.select(key, F.posexplode(column).alias("pos", "t"))
    known = match(each.select(F.col("t.rel_type").alias("source")), candidates, threshold, use_embeddings).select(F.col("source").alias("label"), "canonical")
    clean = F.struct(tx.strip(F.col("t.head")).alias("head"), F.coalesce("canonical", "t.rel_type").alias("rel_type"), tx.strip(F.col("t.tail")).alias("tail"))
    done = each.join(known, F.col("t.rel_type") == F.col("label"), "left").select(key, "pos", clean.alias("t"))
    done = done.where((F.col("t.head") != "") & (F.col("t.rel_type") != "") & (F.col("t.tail") != ""))
    lists = done.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])).alias("_new"))
    return rows.join(lists, key, "left").withColumn(column, F.coalesce("_new", F.slice(column, 1, 0))).drop("_new")
