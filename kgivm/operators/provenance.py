"""Scans, lookups and one-hop joins over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators.sift import key as key_of
from kgivm.operators.sift import sift
from kgivm.store import Graph


def not_removed(status: str | Column = "status") -> Column:
    """Traversals follow an edge unless it is removed (an edge without status is followed)."""
    return ~(F.col(status) if isinstance(status, str) else status).eqNullSafe(F.lit("removed"))


def graph_view(g: Graph, fresh_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (all entities) and edges (relations that are not removed); a fresh edge may name a stale node."""
    nodes, edges = g["entities"], g["relations"].where(not_removed())
    if fresh_only:
        nodes, edges = nodes.where("freshness_status = 'fresh'"), edges.where("freshness_status = 'fresh'")
    return nodes, edges


def sentences(g: Graph, doc_id: str | None = None) -> DataFrame:
    rows = g["sentences"]
    return rows.orderBy("doc_id", "idx") if doc_id is None else rows.where(F.col("doc_id") == doc_id).orderBy("idx")


def logged(g: Graph, table: str, step: int | None = None) -> DataFrame:
    """The delta or decision log, in order of step, or one step of it."""
    rows = g[table] if step is None else g[table].where(F.col("step") == step)
    return rows.orderBy("step", "edit_seq", "position")


def pending(g: Graph) -> DataFrame:
    return logged(g, "refresh_decisions").where("status = 'pending'")


def by_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids`` (one column)."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def sentence(g: Graph, doc_id: str, idx: int) -> DataFrame:
    """One sentence; an error if there is none."""
    rows = g["sentences"].where((F.col("doc_id") == doc_id) & (F.col("idx") == idx))
    if rows.isEmpty():
        raise ValueError(f"sentence not found: {doc_id}:{idx}")
    return rows


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def entity_by_name(g: Graph) -> DataFrame:
    """doc_id, norm_name, entity_id, name: of entities that share a name the one with the lowest index."""
    return first_per(g["entities"].select("doc_id", "norm_name", "entity_id", "name"), ["doc_id", "norm_name"], F.length("entity_id"), F.col("entity_id"))


def live_relation(g: Graph) -> DataFrame:
    """head, rel_type, tail, relation_id: the lowest index among relations that are not removed."""
    live = g["relations"].where(not_removed()).select("head", "rel_type", "tail", "relation_id")
    return first_per(live, ["head", "rel_type", "tail"], F.length("relation_id"), F.col("relation_id"))


def edges_of(g: Graph, scope: str) -> DataFrame:
    """Edges that are not removed and whose target exists."""
    if scope == "mention":
        return g["mentions"].where(not_removed()).join(g["entities"].select(F.col("entity_id").alias("dst")), "dst", "left_semi")
    return g["sentence_supports_relation"].where(not_removed()).join(g["relations"].select(F.col("relation_id").alias("dst")), "dst", "left_semi")


def affected(g: Graph, sents: DataFrame) -> DataFrame:
    """src, target_type, target_id, edge_id of all followed edges of some sentences; repeats stay."""
    ids = sents.select(F.col(sents.columns[0]).alias("src")).distinct()
    out = [edges_of(g, s).join(ids, "src", "left_semi").select("src", F.lit(k).alias("target_type"), F.col("dst").alias("target_id"), "edge_id") for s, k in (("mention", "entity"), ("relation", "relation"))]
    return out[0].unionByName(out[1])


def reachable(g: Graph, sents: DataFrame, max_depth: int = 1) -> DataFrame:
    """Distinct src, target_type, target_id within ``max_depth`` hops. Targets have no out-edges in this schema, so the closure ends after one hop; further hops are followed as long as they find something."""
    found = affected(g, sents).select("src", "target_type", "target_id").distinct()
    frontier, depth = found, 1
    while depth < max_depth:
        step = affected(g, frontier.select("target_id")).withColumnRenamed("src", "via").withColumnsRenamed({"target_id": "next", "target_type": "kind"})
        frontier = frontier.join(step, frontier.target_id == step.via).select("src", F.col("kind").alias("target_type"), F.col("next").alias("target_id")).distinct().join(found, ["src", "target_type", "target_id"], "left_anti")
        if frontier.isEmpty():
            break
        found, depth = found.unionByName(frontier), depth + 1
    return found


def relation_triples(g: Graph, edges: DataFrame) -> DataFrame:
    """``edges`` (with dst: relation) with relation and endpoint names; edges of incomplete relations go."""
    ends = g["entities"].select("entity_id", "name")
    rel = g["relations"].select(F.col("relation_id").alias("dst"), "head", "tail", F.col("rel_type").alias("label"))
    rows = edges.join(rel, "dst").join(ends.select(F.col("entity_id").alias("head"), F.col("name").alias("head_name")), "head")
    return rows.join(ends.select(F.col("entity_id").alias("tail"), F.col("name").alias("tail_name")), "tail")


def current_triples(g: Graph) -> DataFrame:
    """sent_id, triples: what each sentence supports now, in edge order."""
    rows = relation_triples(g, g["sentence_supports_relation"].where(not_removed()))
    item = F.struct("edge_id", F.struct(F.col("head_name").alias("head"), F.col("label").alias("rel_type"), F.col("tail_name").alias("tail")).alias("t"))
    return rows.groupBy(F.col("src").alias("sent_id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]).alias("triples"))


def around(g: Graph, sents: DataFrame) -> Graph:
    """``g`` with only the edges of some sentences (one column of ids), and what these edges lead to; a few rows more come along."""
    near = sift(sents.select(key_of(sents.columns[0])))
    few = {t: near.through(g[t], key_of("src")) for t in ("mentions", "sentence_supports_relation")}
    targets = [few[t].select(key_of("dst")) for t in few]
    few["relations"] = sift(targets[1]).through(g["relations"], key_of("relation_id"))
    few["entities"] = sift(targets[0], *(few["relations"].select(key_of(c)) for c in ("head", "tail"))).through(g["entities"], key_of("entity_id"))
    return g.updated(**few)


def with_evidence(g: Graph, sents: DataFrame, relations_only: bool = False) -> DataFrame:
    """Sentences that have an active mention or relation edge."""
    edges = edges_of(g, "relation").select("src")
    if not relations_only:
        edges = edges.unionByName(edges_of(g, "mention").select("src"))
    return sents.join(edges.select(F.col("src").alias("sent_id")), "sent_id", "left_semi")


def evidence_page(g: Graph, limit: int, offset: int = 0, bearing: bool = True) -> DataFrame:
    """A page of sentences with (or without) relation evidence and their relation_count, by (doc_id, idx)."""
    counts = edges_of(g, "relation").groupBy(F.col("src").alias("sent_id")).agg(F.count("*").alias("relation_count"))
    rows = g["sentences"].join(counts, "sent_id", "left").withColumn("relation_count", F.coalesce("relation_count", F.lit(0)))
    rows = rows.where(F.col("relation_count") > 0 if bearing else F.col("relation_count") == 0)
    return rows.select("sent_id", "doc_id", "idx", "text", "relation_count").orderBy("doc_id", "idx").offset(offset).limit(limit)


def stale(g: Graph, table: str) -> DataFrame:
    key = "entity_id" if table == "entities" else "relation_id"
    return g[table].where("freshness_status = 'stale'").orderBy(key)


def counts(g: Graph) -> DataFrame:
    """name, rows of every table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sorted(g.tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
