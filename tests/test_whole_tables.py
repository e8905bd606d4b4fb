import hashlib
import math
import re
from collections import Counter

from kgivm.plans import registry


def embedding(text):
    """Bucket to signed count, of words and adjacent pairs."""
    words, out = re.findall("[a-z0-9]+", text.lower()), Counter()
    for f in words + [f"{a}_{b}" for a, b in zip(words, words[1:])]:
        h = hashlib.sha1(f.encode()).hexdigest()
        out[int(h[:8], 16) % 384] += 1 if int(h[8:10], 16) % 2 else -1
    return out


def test_hash_embedding_search_reads_texts_of_any_length(spark, tmp_path):
    passage = "what is the tallest mountain of the northern range"
    texts = [passage, " ".join([passage] * 3 + [f"filler{i}" for i in range(40)]), "no such words", " ".join(f"other{i}" for i in range(300)), passage * 20]
    spark.createDataFrame([(0, passage), (1, "other1 other2 other3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for q, a in enumerate((passage, "other1 other2 other3")):
        for d, b in enumerate(texts):
            x, y = embedding(a), embedding(b)
            score = sum(v * y[k] for k, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            if score >= 0.2:
                want[f"b{q}", f"d{d}"] = score
    got = {(r.query_id, r.doc): r.score for r in registry.queries()["hash_embedding_search"](spark, str(tmp_path)).collect()}
    assert len(texts[1]) >= 400 and ("b0", "d1") in want
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_verified_triples_reads_the_whole_turn(spark, tmp_path):
    texts = ["Warsaw is in Poland.", "Warsaw " + "is a large old city " * 10 + "of Poland.", "1 2 3"]
    spark.createDataFrame([(7, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.triple) for r in registry.queries()["verified_triples"](spark, str(tmp_path)).collect()}
    assert len(texts[1]) > 60 and got == {(7, 0, "warsaw|before|poland"), (7, 1, "warsaw|before|poland"), (7, 2, "|before|")}
