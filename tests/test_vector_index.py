import numpy as np
from pyspark.sql import functions as F

from kgivm.operators import retrieval, vector_index


def frames(spark, vectors):
    rows = spark.createDataFrame([(i, [float(x) for x in v], "e") for i, v in enumerate(vectors)], "k long, embedding array<double>, list_ids string")
    return rows, rows.where("k % 20 = 0").select(F.col("k").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_recall_and_exactness(spark, tmp_path):
    """A third of all rows are copies of one vector, the rest lies around 12 centres."""
    rng = np.random.default_rng(3)
    around = rng.normal(size=(12, 16))[rng.integers(0, 12, 400)] + 0.4 * rng.normal(size=(400, 16))
    vectors = np.concatenate([around, np.repeat(around[:1], 200, axis=0), np.zeros((1, 16))])
    rows, queries = frames(spark, vectors)
    index = vector_index.build(rows.drop("list_ids"), f"file://{tmp_path}/i")
    assert index.status == "created" and index.rows.count() == 601 and index.rows.select("list_id").distinct().count() > 5
    exact = retrieval.search(rows.select("k", "embedding"), queries, key="k", limit=5)
    assert vector_index.recall(index, queries, exact, key="k") >= 0.9
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    whole = vector_index.search(index, queries, key="k", limit=3, probes=len(index.centres)).collect()
    for q in range(0, 601, 20):
        want = sorted(np.round(unit @ unit[q], 9))[::-1][:3]
        assert [round(r.score, 6) for r in sorted((r for r in whole if r.query_id == q), key=lambda r: r.rank)] == [round(float(x), 6) for x in want]


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, []), (6, [0.9, 0.1])], "k long, embedding array<double>")
    index = vector_index.build(rows, f"file://{tmp_path}/i")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert [r.k for r in vector_index.search(index, q, key="k", threshold=0.5).orderBy("rank").collect()] == [1, 6]
    none = vector_index.build(rows.where("k = 2"), f"file://{tmp_path}/n")
    assert none.status == "missing_embeddings" and vector_index.search(none, q, key="k").count() == 0
