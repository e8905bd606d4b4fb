import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgivm.functions import vectors as vx
from kgivm.operators import evaluation, pairs, vector_index
from kgivm.plans import registry
from kgivm.staging import pinned


@pytest.fixture
def odd(spark):
    """Vectors of few values, so many scores are equal or on a threshold; copies, zeros, nulls, other lengths, a null inside, no label."""
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.integers(-1, 2, size=(260, 4))] + [[3.0, 4.0, 0.0, 0.0]] * 60 + [None, [], [1.0], [1.0, None, 0.0, 0.0], [1e308] * 4]
    data = [(i, v, None if i % 37 == 5 else i % 7) for i, v in enumerate(vectors)]
    rows = spark.createDataFrame(data, "k long, embedding array<double>, label long").repartition(5)
    queries = rows.where("k % 20 = 0 or k >= 318").select(F.col("k").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("want"))
    scored = rows.join(queries, F.col("k") != F.col("query_id")).select("query_id", "k", (F.col("label") == F.col("want")).alias("relevant"), vx.cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "k")
    return rows, queries, scored, scored.withColumn("rank", F.row_number().over(best))


def got(df, *columns):
    return sorted((tuple("nan" if x != x else x for x in r) for r in df.select(*columns).collect()), key=str)


def test_blocks_give_what_all_pairs_give(odd):
    rows, queries, scored, ranked = odd
    assert got(pairs.threshold_counts(rows, queries, [0.0, 0.5, 0.6], key="k"), "threshold", "tp", "fp", "fn", "tn") == got(evaluation.threshold_sweep(scored, [0.0, 0.5, 0.6]), "threshold", "tp", "fp", "fn", "tn")
    first = ranked.where("relevant").groupBy("query_id").agg(F.min("rank").alias("rank"))
    assert got(pairs.first_relevant(rows, queries, key="k", digits=9, pin=pinned), "query_id", "rank") == got(ranked.select("query_id").distinct().join(first, "query_id", "left"), "query_id", "rank")
    best = pairs.best(rows, queries, key="k", limit=6, digits=9, itself=False)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "k")
    assert got(best.withColumn("rank", F.row_number().over(order)).where("rank <= 6"), "query_id", "k", "rank", "score") == got(ranked.where("rank <= 6"), "query_id", "k", "rank", "score")


@pytest.mark.parametrize("name", ["topk_cosine", "hit_at_k", "threshold_sweep", "indexed_search"])
def test_no_row_for_each_pair(spark, tmp_path, name):
    """The only join of vectors is that of blocks: none is scored as a row of its own."""
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(200)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "mapInArrow" in plan.replace("MapInArrow", "mapInArrow") and "zip_with" not in plan and "zipwith" not in plan.lower() and df.count() > 0


def test_index_reads_only_its_lists(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(600)]
    rows = spark.createDataFrame(data, "k long, embedding array<double>")
    index = vector_index.build(rows, f"file://{tmp_path}/i", lists=12)
    queries = rows.where("k % 20 = 0").select(F.col("k").alias("query_id"), F.col("embedding").alias("query_vector"))
    lists = vector_index._nearest(queries, "query_vector", index.centres, 3).select("query_id", "query_vector", F.explode("list_ids").alias("list_id"))
    scored = index.rows.join(lists, "list_id").select("query_id", "k", vx.cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "k"))).where("rank <= 5")
    assert got(vector_index.search(index, queries, key="k", probes=3), "query_id", "k", "score", "rank") == got(want, "query_id", "k", "score", "rank")
