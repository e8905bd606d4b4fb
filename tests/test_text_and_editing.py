import json

import pytest
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.functions import vectors as vx
from kgivm.operators import benchmark, editor, evaluation, ontology, retrieval
from kgivm.schemas import TRIPLES
from kgivm.sources import corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def triples(*rows):
    return F.from_json(F.lit(json.dumps([dict(zip(("head", "rel_type", "tail"), r)) for r in rows])), TRIPLES)


def names(value):
    return [(t.head, t.rel_type, t.tail) for t in value]


MADE, MOORED, NEW = ("Aurelia", "manufacturer", "Lindqvist Yard"), ("Aurelia", "moored at", "Norrhamn"), ("Aurelia", "manufacturer", "Sund Works")


def test_scalars(spark):
    cases = [
        (tx.normalize_name(F.lit("  Lake\t  VETTER ")), "lake vetter"), (tx.remove_phrase(F.lit("The ferry stops at Norrhamn ."), F.lit("Norrhamn")), "The ferry stops at ."),
        (tx.remove_phrase(F.lit("a (x) b"), F.lit("(x)")), "a b"), (tx.remove_phrase(F.lit("x, Sund, y Sund"), F.lit("Sund")), "x, y Sund"), (tx.replace_phrase(F.lit("in Sund, Sunda"), F.lit("Sund"), F.lit("a$1\\b")), "in a$1\\b, Sunda"),
        (tx.phrase_occurs(F.lit("party"), F.lit("art")), False), (tx.cleanup(F.lit(" a  , , b ( ) ")), "a , b"), (tx.safe_key(F.lit("doc0:r_auto"), F.lit("doc0:e0"), F.lit("country"), F.lit("doc0:e2")), "doc0:r_auto_d3bc3dfc99c84f94"),
        (F.array_join(tx.focus_terms(F.lit("Replace A b with C")), ";"), "A b"), (F.array_join(tx.focus_terms(F.lit("drop X then replace A with B")), ";"), "A;X then replace A with B"), (tx.as_int(F.lit(" 12 ")), 12), (tx.as_int(F.lit("x")), 0),
        (tx.in_doc(F.lit("doc10:1"), "doc1"), False), (tx.ratio(F.lit(1), F.lit(0)), None), (tx.json_object(F.lit("```json\n{\"a\": {}}\n```")), '{"a": {}}'), (tx.changed_value(F.lit("moored in Sund"), F.lit("moored in Solvik"))["new"], "Solvik"),
    ]
    for got, want in cases:
        assert one(spark, got) == want, want


def test_json_triples(spark):
    assert names(one(spark, tx.triples_of_json(F.lit('[["a","b","c"],["x","y"],[" ","b","c"],null]')))) == [("a", "b", "c")]


def test_verifier(spark):
    text = F.lit("Lindqvist Yard sold Aurelia to Norrhamn")
    v = lambda current, t, cand, old=(): names(one(spark, editor.verify(triples(*current), t, triples(*cand), triples(*old))))
    assert v([MADE, MOORED], text, [MOORED]) == [MOORED, MADE]
    both = F.lit("Sund Works, not Lindqvist Yard, built Aurelia")
    assert v([MADE], both, [NEW], [MADE]) == [NEW]
    assert v([MADE], both, [NEW]) == [NEW, MADE]
    assert v([MADE], F.lit("nothing"), []) == []
    assert names(one(spark, tx.superseded(triples(MADE, MOORED), F.lit("Replace the old fact Aurelia manufacturer Lindqvist Yard. with Sund Works")))) == [MADE]
    assert names(one(spark, tx.superseded(triples(MADE, MOORED), F.lit("rewrite it")))) == []


def test_label_matching(spark):
    m = lambda labels, cands, **k: {r.source: (r.canonical, r.method, r.status, round(r.confidence, 4)) for r in ontology.match(spark.createDataFrame([(x,) for x in labels], "source string"), spark.createDataFrame(list(enumerate(cands)), "position int, label string"), **k).collect()}
    got = m(["participant  in", "country citizenship", "born in"], ["place of birth", "country of citizenship", "participant in"], threshold=0.75)
    assert got == {"participant  in": ("participant in", "exact", "accepted", 1.0), "country citizenship": ("country of citizenship", "lexical", "accepted", 0.9268), "born in": ("place of birth", "alias", "accepted", 1.0)}
    assert m(["birth location"], ["place of birth", "place of death"])["birth location"][:3] == ("birth location", "lexical", "unresolved")
    assert m(["x"], [])["x"] == ("x", "none", "unresolved", 0.0)
    assert m(["country citizenship"], ["country of citizenship"], use_embeddings=True)["country citizenship"][2] == "accepted"


def test_canonical_triples(spark):
    t = [(" Sigrid ", "born in", "Sund"), ("Sigrid", "place of birth", "Sund"), ("", "x", "y"), ("a", "nationality", "b"), ("a", "nationality", "b")]
    frame = spark.range(1).select(F.col("id").alias("k"), triples(*t).alias("triples"))
    got = ontology.canonicalize(frame, spark.createDataFrame([], "position int, label string"), key="k").first().triples
    assert names(got) == [("Sigrid", "place of birth", "Sund"), ("a", "country of citizenship", "b")]


def test_search(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "sent_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert [r.sent_id for r in retrieval.search(rows, q, key="sent_id").orderBy("rank").collect()] == ["a", "b"]
    assert [r.sent_id for r in retrieval.search(rows, q, key="sent_id", threshold=0.5).collect()] == ["a"]
    e = vx.hashed_embedding(F.lit("Seven ferries wait for the ice to break"))
    assert one(spark, F.size(e)) == 384 and one(spark, vx.cosine(e, e)) > 0.99
    assert one(spark, vx.norm(vx.hashed_embedding(F.lit("...")))) == 0.0
    assert one(spark, vx.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_document_instruction(store, spark):
    g = retrieval.store_embeddings(store.load())
    ask = spark.createDataFrame([(0, "doc0", "remove Norrhamn")], "instruction_id int, doc_id string, instruction string")
    got = editor.build_edits(g, ask).orderBy("edit_seq").collect()
    assert [(r.sent_idx, r.new_text, len(r.intended_triples)) for r in got] == [(0, "Lindqvist Yard built the ferry Aurelia in .", 1), (1, "lies on Lake Vetter .", 0)]
    swap = spark.createDataFrame([(0, "doc0", "replace Norrhamn with Sundvik")], "instruction_id int, doc_id string, instruction string")
    assert [r.new_text for r in editor.build_edits(g, swap, selector="embedding", limit=1).collect()][0].count("Sundvik") == 1
    with pytest.raises(ValueError):
        editor.build_edits(g, ask, input_kind="fact")
    assert retrieval.embedded(g).first().embedded == 3
    edits = spark.createDataFrame([("doc0", 0, "Lindqvist Yard built the ferry Aurelia in Norrhamn .")], "doc_id string, sent_idx int, new_text string")
    assert retrieval.similar_after_edit(g, edits).first().is_similar


def test_workload(store):
    g = store.load()
    work = benchmark.workload(g, 1)
    got = {r.scenario: r for r in work.collect()}
    assert set(got) == {"semantic_noop", "remove_relation", "change_relation_tail"} and got["remove_relation"].new_text == "Norrhamn lies on ."
    assert got["change_relation_tail"].new_text == "Each summer Aurelia crosses Benchmark Entity 3 ."
    result, rows = benchmark.compare(g, work)
    noop = rows.where("scenario = 'semantic_noop'").first()
    assert (noop.ours_cost, noop.skip, noop.unchanged, noop.b1_reachable, noop.document_cost) == (0, 4, 4, 4, 35)
    total = {r.scenario: r for r in evaluation.scenario_summary(rows).collect()}
    assert total[None].edits == 3 and total["semantic_noop"].b1_over_ours is None
    assert benchmark.triples_changed(work).count() == 4
    assert benchmark.decision_audit(result).where("missing").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"_comment": "x", "doc_id": "doc0", "sent_idx": 1, "new_text": "t", "intended_triples": [["a", "b", "c"]]}, {"doc_id": "d", "sent_idx": 0, "new_text": "u"}]))
    got = corpus.read_edits(spark, str(tmp_path / "e.json")).orderBy("edit_seq").collect()
    assert [(r.edit_seq, r.doc_id, names(r.intended_triples)) for r in got] == [(0, "doc0", [("a", "b", "c")]), (1, "d", [])]
    (tmp_path / "odd.json").write_text(json.dumps([{"sents": [["A", "b"]], "vertexSet": [[{"name": "A", "sent_id": 0, "pos": [0, 1]}]], "labels": [{"h": 0, "t": 0, "r": "P9"}]}, {"title": "no labels", "sents": [], "vertexSet": []}]))
    t = corpus.ingest(corpus.parse_corpus(spark, str(tmp_path / "odd.json")))
    r = t["relations"].first()
    assert (r.rel_type, r.evidence_count, t["entities"].first().type, t["documents"].count()) == ("P9", 0, "", 2)
    frame = spark.createDataFrame([(1, [1, 2], {"a": 1})], "i int, l array<int>, m map<string,int>")
    corpus.write_rows(frame, str(tmp_path / "j"))
    assert corpus.read_rows(spark, str(tmp_path / "j"), "i int, l array<int>").first().l == [1, 2]
    corpus.write_rows(frame, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().l == "[1,2]"
    assert [r.line for r in corpus.markdown(frame.select("i")).orderBy("position").collect()] == ["| i |", "|---|", "| 1 |"]


def test_stream_and_engine(spark, tmp_path, store, edits):
    from kgivm.engine import Engine
    from kgivm.streaming.edits import edit_stream, maintain

    edits(("doc0", 0, "Lindqvist Yard stands alone.", [])).write.parquet(str(tmp_path / "in"))
    maintain(edit_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    e = Engine(spark, store.path)
    assert e.state.step == 1 and e.metrics().first().REBUILD == 1
    assert e.check(require_fresh=True)[1].first().consistent
    assert e.deltas(1).count() == 4 and e.decisions(2).count() == 0
    assert e.graph()[1].count() == 2 and e.baseline(spark.createDataFrame([("doc0:1",)], "s string")).first().stale_count == 4
    e.reset()
    assert e.counts().agg(F.sum("rows")).first()[0] == 0


def test_stream_batches_are_applied_once(store, edits, monkeypatch):
    """A batch that fails before the pointer moves leaves nothing; one that fails after it is not applied again."""
    from kgivm.store import Store
    from kgivm.streaming.edits import apply_once

    batch = edits(("doc0", 1, "Lake Vetter", []))
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda self, graph: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            apply_once(store, batch, 0)
    assert (store.load().step, store.load().batch) == (0, -1)
    assert apply_once(store, batch, 0) and not apply_once(store, batch, 0)
    assert (store.load().step, store.load().batch) == (1, 0)
    assert not apply_once(store, batch.limit(0), 1)
    assert store.clear().batch == 0


def test_cached_answers_and_outcomes(store, spark, edits):
    from kgivm.operators.pipeline import apply_batch

    g = store.load()
    ask = spark.createDataFrame([(0, "doc0", "remove Norrhamn")], "instruction_id int, doc_id string, instruction string")
    answers = spark.createDataFrame([("m", "doc0:0", "remove Norrhamn", "From a cache.", [], True), ("other", "doc0:1", "remove Norrhamn", "no", [], True)], f"provider string, sent_id string, instruction string, new_text string, candidate {TRIPLES}, applies boolean")
    got = editor.build_edits(g, ask, provider=editor.cached(editor.heuristic, answers, "m")).orderBy("sent_idx").collect()
    assert [r.new_text for r in got] == ["From a cache.", "lies on Lake Vetter ."]

    result = apply_batch(g, edits(("doc0", 0, "Sund Works built Aurelia", [NEW]), ("doc0", 1, "Lake Vetter", [])), 1)
    cases = spark.createDataFrame([(0, MADE, NEW, 1), (1, ("Norrhamn", "lies by", "Lake Vetter"), NEW, 2)], "edit_seq long, old struct<head:string,rel_type:string,tail:string>, new struct<head:string,rel_type:string,tail:string>, active_before int")
    out = {r.edit_seq: r for r in evaluation.edit_outcomes(result, cases).collect()}
    assert (out[0].delta_correct, out[0].decision_correct) == (True, True)
    assert (out[1].old_removed, out[1].new_added, out[1].old_decision) == (True, False, False)
    assert evaluation.mean_flags(evaluation.edit_outcomes(result, cases), "delta_correct").first().delta_correct == 0.5
