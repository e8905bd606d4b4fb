"""Queries over texts, vectors and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import editor, evaluation, ontology, pairs, retrieval
from kgivm.sources.tables import table
from kgivm.staging import pinned

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


LINES = "WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), lines AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS idx FROM parts) "


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))


@query(LINES + "SELECT 'doc' || doc_id || ':' || idx AS sent_id, sha1(text) AS text_hash FROM lines")
def sentence_split_hash(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).select(tx.sentence_id(F.concat(F.lit("doc"), "doc_id"), F.col("idx")).alias("sent_id"), tx.text_hash(F.col("text")).alias("text_hash"))


@query(LINES + "SELECT doc_id, idx::INTEGER AS idx, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS norm FROM lines")
def normalized_text(spark, sf_dir) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "idx", tx.normalize_name(F.col("text")).alias("norm"))


@query("SELECT sha1(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_text_hash(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy(tx.text_hash(F.col("text")).alias("text_hash"))
    return docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(LINES + ", words AS (SELECT doc_id, idx, text, regexp_extract(text, '([A-Za-z]{4,})', 1) AS w FROM lines) SELECT doc_id, count(*) AS lines, count_if(w <> '' AND contains(lower(text), lower(w)))::BIGINT AS named FROM words GROUP BY doc_id")
def name_in_text(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("w", F.regexp_extract("text", "([A-Za-z]{4,})", 1))
    hit = (F.col("w") != "") & F.contains(F.lower("text"), F.lower("w"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(hit).alias("named"))


@query(None)
def phrase_remove_first(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("w", F.regexp_extract("text", r"(?U)(\w{3,})", 1)).where("w <> ''")
    return rows.select("doc_id", "idx", tx.remove_phrase(F.col("text"), F.col("w")).alias("text"))


@query(None)
def phrase_replace_first(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("w", F.regexp_extract("text", r"(?U)(\w{3,})", 1)).where("w <> ''")
    return rows.select("doc_id", "idx", tx.replace_phrase(F.col("text"), F.col("w"), F.lit("New $1 Name")).alias("text"))


RANKED = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS want FROM embeddings WHERE vec_id % 20 = 0),
scored AS (SELECT q.query_id, e.vec_id, (e.label = q.want) AS relevant,
  list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)) + 1e-10) AS score FROM embeddings e CROSS JOIN q WHERE e.vec_id <> q.query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scored) """


def _asked(spark, sf_dir):
    """All rows, and the query set (every 20th vector)."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("want"))


@query(RANKED + "SELECT query_id, vec_id, rank::BIGINT AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def topk_cosine(spark, sf_dir) -> DataFrame:
    found = pairs.best(*_asked(spark, sf_dir), key="vec_id", limit=10, digits=9, itself=False)
    best = evaluation.Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where("rank <= 10").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    RANKED
    + """, f AS (SELECT q.query_id, min(r.rank) FILTER (relevant) AS first FROM q JOIN ranked r USING (query_id) GROUP BY ALL)
SELECT count(*) AS queries, round(avg((first <= 1)::INT), 6) AS hit_1, round(avg((first <= 3)::INT), 6) AS hit_3, round(avg((first <= 5)::INT), 6) AS hit_5, round(avg((first <= 10)::INT), 6) AS hit_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f"""
)
def hit_at_k(spark, sf_dir) -> DataFrame:
    first = pairs.first_relevant(*_asked(spark, sf_dir), key="vec_id", digits=9, pin=pinned)
    out = evaluation.ranking(first.withColumn("relevant", F.col("rank").isNotNull()), first)
    return out.select("queries", *(F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "hit_10", "mrr")))


@query(
    RANKED
    + """, t AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8])::DOUBLE AS threshold), c AS (SELECT threshold, count_if(score >= threshold AND relevant) AS tp, count_if(score >= threshold AND NOT relevant) AS fp, count_if(score < threshold AND relevant) AS fn FROM scored, t GROUP BY ALL)
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM c"""
)
def threshold_sweep(spark, sf_dir) -> DataFrame:
    out = evaluation.measures(pairs.threshold_counts(*_asked(spark, sf_dir), [0.0, 0.2, 0.4, 0.6, 0.8], key="vec_id"))
    return out.select("threshold", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    """WITH raw AS (SELECT 'b' || item_id AS id, lower(text) AS t FROM benchmark UNION ALL SELECT 'd' || doc_id, lower(text) FROM documents WHERE n_chars < 400),
toks AS (SELECT id, regexp_extract_all(t, '[a-z0-9]+') AS w FROM raw), feats AS (SELECT id, unnest(list_concat(w, [w[i] || '_' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM toks),
placed AS (SELECT id, ('0x' || left(sha1(f), 8))::BIGINT % 384 AS b, sum(CASE WHEN ('0x' || substr(sha1(f), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM feats GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(v * v)) AS n FROM placed GROUP BY id),
pairs AS (SELECT q.id AS query_id, d.id AS doc, sum(q.v * d.v) AS dot FROM placed q JOIN placed d ON q.b = d.b WHERE q.id LIKE 'b%' AND d.id LIKE 'd%' GROUP BY ALL),
scored AS (SELECT query_id, doc, round(dot / (a.n * b.n), 6) AS score FROM pairs JOIN norms a ON a.id = query_id JOIN norms b ON b.id = doc WHERE dot / (a.n * b.n) >= 0.2)
SELECT query_id, doc, score FROM scored"""
)
def hash_embedding_search(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("query_id"), "text")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), "text")
    return retrieval.search_texts(d, q, key="doc", threshold=0.2).select("query_id", "doc", F.round("score", 6).alias("score"))


@query(
    """WITH j AS (SELECT (d.n_chars >= 300) AS p, (l.quality = 1) AS a FROM labels l LEFT JOIN documents d USING (doc_id)), c AS (SELECT count_if(coalesce(p, false) AND a) AS tp, count_if(coalesce(p, false) AND NOT a) AS fp, count_if(NOT coalesce(p, false) AND a) AS fn, count_if(NOT coalesce(p, false) AND NOT a) AS tn FROM j)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c"""
)
def confusion_metrics(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "left")
    out = evaluation.confusion(rows.select((F.col("n_chars") >= 300).alias("p"), (F.col("quality") == 1).alias("a")), "p", "a")
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query(
    """WITH r AS (SELECT l.doc_id, l.quality = 1 AS should_edit, contains(lower(trim(regexp_replace(d.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 'the') AS holds, l.toxic = 0 AS supports FROM labels l JOIN documents d USING (doc_id))
SELECT doc_id, CASE WHEN should_edit AND NOT holds THEN 'FLAG-1' WHEN NOT should_edit AND holds AND supports THEN 'FLAG-2' END AS flag FROM r"""
)
def label_audit_flags(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", "text", F.lit("the").alias("old_value"), (F.col("quality") == 1).alias("should_edit"), (F.col("toxic") == 0).alias("supports"))
    return evaluation.label_flags(rows).select("doc_id", "flag")


LABELS = ["place of birth", "country of citizenship", "participant in", "location", "coach"]
ASKED = ["birthplace", "Country of Citizenship", "born  in", "participant  in", "quite another", "LOCATION"]


def _rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


@query(
    """SELECT * FROM (VALUES ('birthplace', 'place of birth', 'alias', 'accepted'), ('Country of Citizenship', 'country of citizenship', 'exact', 'accepted'), ('born  in', 'place of birth', 'alias', 'accepted'),
('participant  in', 'participant in', 'exact', 'accepted'), ('quite another', 'quite another', 'lexical', 'unresolved'), ('LOCATION', 'location', 'exact', 'accepted')) t(source, canonical, method, status)"""
)
def relation_match(spark, sf_dir) -> DataFrame:
    got = ontology.match(_rows(spark, [(x,) for x in ASKED], "source string"), _rows(spark, list(enumerate(LABELS)), "position int, label string"))
    return got.select("source", "canonical", "method", "status")


@query(None)
def relation_match_lexical(spark, sf_dir) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("source")).distinct()
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label")).distinct()
    names = names.select(F.row_number().over(evaluation.Window.orderBy("label")).alias("position"), "label")
    return ontology.match(types, names)


@query(
    """WITH w AS (SELECT doc_id, regexp_extract(text, '([A-Za-z]{3,})', 1) AS a, regexp_extract(text, '([A-Za-z]{3,})[^A-Za-z]*$', 1) AS b FROM documents), i AS (SELECT doc_id, a, b, CASE doc_id % 3 WHEN 0 THEN 'Replace ' || a || ' with ' || b WHEN 1 THEN 'please remove ' || a ELSE 'nothing to do' END AS instruction FROM w WHERE a <> '' AND b <> '')
SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN '' ELSE a END AS terms, doc_id % 3 = 0 AS is_replacement FROM i"""
)
def instruction_focus(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.regexp_extract("text", "([A-Za-z]{3,})", 1).alias("a"), F.regexp_extract("text", "([A-Za-z]{3,})[^A-Za-z]*$", 1).alias("b")).where("a <> '' AND b <> ''")
    kind = F.col("doc_id") % 3
    rows = rows.withColumn("i", F.when(kind == 0, F.concat(F.lit("Replace "), "a", F.lit(" with "), "b")).when(kind == 1, F.concat(F.lit("please remove "), "a")).otherwise("nothing to do"))
    return rows.select("doc_id", F.array_join(tx.focus_terms(F.col("i")), ";").alias("terms"), tx.is_replacement(F.col("i")).alias("is_replacement"))


@query(
    """WITH t AS (SELECT conv_id, turn, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS a, lower(regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1)) AS b, lower(left(text, 60)) AS x FROM conversations)
SELECT conv_id, turn, a || '|before|' || b AS triple FROM t WHERE contains(x, a) AND contains(x, b)"""
)
def verified_triples(spark, sf_dir) -> DataFrame:
    word = lambda pattern: F.lower(F.regexp_extract("text", pattern, 1))
    triple = F.struct(word("([A-Za-z]+)").alias("head"), F.lit("before").alias("rel_type"), word("([A-Za-z]+)[^A-Za-z]*$").alias("tail"))
    rows = table(spark, sf_dir, "conversations").withColumn("triples", F.array(triple))
    kept = editor.verify(F.col("triples"), F.col("text"), F.slice("triples", 1, 0), F.slice("triples", 1, 0))
    return rows.select("conv_id", "turn", F.explode(kept).alias("t")).select("conv_id", "turn", F.concat_ws("|", "t.head", "t.rel_type", "t.tail").alias("triple"))


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS triple FROM conversations), a AS (SELECT conv_id || '/' || turn AS k, triple FROM w WHERE turn < (SELECT max(turn) FROM conversations)), b AS (SELECT conv_id || '/' || (turn - 1) AS k, triple FROM w WHERE turn > 0)
SELECT k, change, count(*) AS n FROM (SELECT k, 'removed' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL"""
)
def turn_token_diff(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    top = c.agg(F.max("turn").alias("top"))
    words = c.crossJoin(F.broadcast(top)).select("conv_id", "turn", "top", F.explode(F.split("text", " ", -1)).alias("triple"))
    a = words.where("turn < top").withColumn("k", F.concat_ws("/", "conv_id", "turn"))
    b = words.where("turn > 0").withColumn("k", F.concat_ws("/", "conv_id", F.col("turn") - 1))
    return evaluation.triple_diff(a, b, "k").groupBy("k", "change").agg(F.count("*").alias("n"))
