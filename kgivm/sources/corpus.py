"""Corpus, relation names and edits from JSON; the tables of a fresh graph; row sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.schemas import TABLES

# Fixed value: what the documents table says about its origin.
SOURCE = "re-docred"
CORPUS = (
    "array<struct<title:string,sents:array<array<string>>,vertexSet:array<array<struct<name:string,type:string,sent_id:int,pos:array<int>>>>,"
    "labels:array<struct<h:int,t:int,r:string,evidence:array<int>>>>>"
)


def whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One column ``v``: the file's JSON value (one file is one value)."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("v"))


def relation_names(spark: SparkSession, path: str | None) -> DataFrame:
    """rel_id, rel_name of a {P-id: name} file; empty without a file."""
    if path is None:
        return spark.createDataFrame([], "rel_id string, rel_name string")
    return whole_json(spark, path, "map<string,string>").select(F.explode("v").alias("rel_id", "rel_name"))


def parse_corpus(spark: SparkSession, path: str, relation_path: str | None = None, limit: int | None = None) -> DataFrame:
    """doc_id, title, sents (texts), vertices, labels with relation names, in file order."""
    docs = whole_json(spark, path, CORPUS).select(F.posexplode("v").alias("pos", "d"))
    if limit is not None:
        docs = docs.where(F.col("pos") < limit)
    docs = docs.select(
        "pos", F.concat(F.lit("doc"), "pos").alias("doc_id"), F.coalesce("d.title", F.lit("")).alias("title"),
        F.transform("d.sents", lambda s: F.array_join(s, " ")).alias("sents"), F.coalesce("d.vertexSet", F.array()).alias("vertices"), F.coalesce("d.labels", F.array()).alias("labels"),
    )
    names = relation_names(spark, relation_path).agg(F.map_from_entries(F.collect_list(F.struct("rel_id", "rel_name"))).alias("names"))
    named = lambda l: F.struct(l["h"].alias("h"), l["t"].alias("t"), l["r"].alias("rel_id"), F.coalesce(F.try_element_at("names", l["r"]), l["r"]).alias("rel_type"), F.coalesce(l["evidence"], F.array().cast("array<int>")).alias("evidence"))  # noqa: E731,E741
    # the dictionary is one row
    return docs.crossJoin(F.broadcast(names)).withColumn("labels", F.transform("labels", named)).drop("names")


def ingest(parsed: DataFrame) -> dict[str, DataFrame]:
    """All tables of a fresh graph."""
    spark = parsed.sparkSession
    fresh = (F.lit("fresh").alias("freshness_status"), F.lit(0).alias("last_changed_step"))
    sents = parsed.select("doc_id", F.posexplode("sents").alias("idx", "text"))
    vertices = parsed.select("doc_id", F.posexplode("vertices").alias("v", "at"))
    labels = parsed.select("doc_id", F.posexplode("labels").alias("n", "l"))
    entity = F.concat_ws(":e", "doc_id", "v")
    relation = F.concat_ws(":r", "doc_id", "n")
    first = F.get("at", F.lit(0))
    mentions = vertices.select("doc_id", entity.alias("dst"), F.posexplode("at").alias("k", "m"))
    supports = labels.select("doc_id", relation.alias("dst"), F.col("l.rel_type").alias("rel_type"), F.posexplode("l.evidence").alias("k", "s"))
    edge = (F.lit("active").alias("status"), F.lit(0).alias("added_step"), F.lit(None).cast("int").alias("removed_step"))
    tables = {
        "documents": parsed.select("doc_id", "title", F.size("sents").alias("num_sents"), F.lit(SOURCE).alias("source")),
        "sentences": sents.select(
            tx.sentence_id(F.col("doc_id"), F.col("idx")).alias("sent_id"), "doc_id", "idx", "text", tx.text_hash(F.col("text")).alias("text_hash"), F.lit("active").alias("status"),
            F.lit(0).alias("last_changed_step"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("embedding_backend"),
        ),
        "entities": vertices.select(
            entity.alias("entity_id"), "doc_id", first["name"].alias("name"), tx.normalize_name(first["name"]).alias("norm_name"), F.coalesce(first["type"], F.lit("")).alias("type"),
            F.size("at").cast("long").alias("evidence_count"), *fresh,
        ),
        "relations": labels.select(
            relation.alias("relation_id"), "doc_id", F.concat_ws(":e", "doc_id", "l.h").alias("head"), F.concat_ws(":e", "doc_id", "l.t").alias("tail"), F.col("l.rel_id").alias("rel_id"), F.col("l.rel_type").alias("rel_type"),
            F.size("l.evidence").cast("long").alias("evidence_count"), F.lit("fresh").alias("freshness_status"), F.lit("active").alias("status"), F.lit(0).alias("last_changed_step"),
        ),
        "mentions": mentions.select(F.concat_ws("#m", "dst", F.lpad("k", 6, "0")).alias("edge_id"), tx.sentence_id(F.col("doc_id"), F.col("m.sent_id")).alias("src"), "dst", F.col("m.name").alias("surface"), *edge),
        "sentence_supports_relation": supports.select(F.concat_ws("#s", "dst", F.lpad("k", 6, "0")).alias("edge_id"), tx.sentence_id(F.col("doc_id"), F.col("s")).alias("src"), "dst", "rel_type", *edge),
    }
    return tables | {t: spark.createDataFrame([], TABLES[t]) for t in ("evidence_deltas", "refresh_decisions")}


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """The edits of a JSON array, numbered in file order; unknown fields are ignored."""
    raw = whole_json(spark, path, "array<struct<doc_id:string,sent_idx:int,new_text:string,intended_triples:array<array<string>>>>")
    triples = F.transform(F.coalesce("e.intended_triples", F.array()), lambda t: F.struct(F.get(t, F.lit(0)).alias("head"), F.get(t, F.lit(1)).alias("rel_type"), F.get(t, F.lit(2)).alias("tail")))
    return raw.select(F.posexplode("v").alias("p", "e")).select(F.col("p").cast("long").alias("edit_seq"), "e.doc_id", "e.sent_idx", "e.new_text", triples.alias("intended_triples"))


def write_rows(df: DataFrame, path: str, kind: str = "jsonl") -> None:
    """JSON lines, or CSV with nested columns as JSON text."""
    if kind == "jsonl":
        df.write.mode("overwrite").json(path)
        return
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and lines that are no object are skipped."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def markdown(df: DataFrame) -> DataFrame:
    """position, line: a Markdown table of a (small, ordered) summary."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "position long, line string")
    order = F.row_number().over(Window.orderBy(*df.columns)) + 1
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    return head.unionByName(df.select(order.cast("long").alias("position"), cells.alias("line")))
