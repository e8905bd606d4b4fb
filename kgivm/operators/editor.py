"""From instructions to edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgivm.functions import text as tx
from kgivm.operators import ontology, retrieval
from kgivm.operators import provenance as pv
from kgivm.schemas import TRIPLES
from kgivm.staging import pinned
from kgivm.store import Graph

#: A provider takes sent_id, text, triples, instruction and adds new_text, candidate (triples) and applies. It can be a pandas UDF around any model.
Provider = Callable[[DataFrame], DataFrame]


def rewrite(text: Column, instruction: Column) -> Column:
    """A replacement beats a removal; anything else leaves the text."""
    old, new = tx.replaced(instruction)
    gone = tx.dropped(instruction)
    return F.when(old != "", tx.replace_phrase(text, old, new)).when(gone != "", tx.remove_phrase(text, gone)).otherwise(text)


def supported(triples: Column, text: Column) -> Column:
    """Triples whose both ends occur in the text."""
    norm = tx.normalize_name(text)
    return F.filter(triples, lambda t: F.contains(norm, tx.normalize_name(t["head"])) & F.contains(norm, tx.normalize_name(t["tail"])))


def verify(current: Column, text: Column, candidates: Column, replaced: Column) -> Column:
    """Candidates and the current triples that the text still supports, without those that a candidate of the same head and label replaces."""
    n = tx.normalize_name
    gone = F.filter(F.array_intersect(current, replaced), lambda old: F.exists(candidates, lambda c: (n(c["head"]) == n(old["head"])) & (n(c["rel_type"]) == n(old["rel_type"])) & (n(c["tail"]) != n(old["tail"]))))
    kept = F.filter(candidates, lambda c: ~F.coalesce(F.array_contains(gone, c), F.lit(False)))
    rest = F.filter(F.array_distinct(supported(current, text)), lambda t: ~F.array_contains(gone, t) & ~F.array_contains(kept, t))
    return F.concat(kept, rest)


def heuristic(rows: DataFrame) -> DataFrame:
    """The provider without a model."""
    out = rows.withColumn("new_text", rewrite(F.col("text"), F.col("instruction")))
    return out.withColumn("candidate", supported(F.col("triples"), F.col("new_text"))).withColumn("applies", F.lit(True))


def cached(provider: Provider, answers: DataFrame, name: str) -> Provider:
    """A provider that asks only for what ``answers`` (provider, sent_id, instruction, new_text, candidate, applies) does not hold under its name."""
    keys = ["sent_id", "instruction"]

    def run(rows: DataFrame) -> DataFrame:
        known = answers.where(F.col("provider") == name).select(*keys, "new_text", "candidate", "applies").dropDuplicates(keys)
        asked = provider(rows.join(known.select(*keys), keys, "left_anti"))
        return rows.join(known, keys).select(*asked.columns).unionByName(asked)

    return run


def select_by_evidence(g: Graph, instructions: DataFrame, input_kind: str = "instruction") -> DataFrame:
    """instruction_id, sent_id: evidence-bearing sentences of the instruction's document that hold a focus term; without focus terms, those whose triples' ends the instruction names."""
    terms = F.array().cast("array<string>") if input_kind == "fact" else F.transform(tx.focus_terms(F.col("instruction")), tx.normalize_name)
    norm, asked = tx.normalize_name(F.col("text")), tx.normalize_name(F.col("instruction"))
    named = F.exists(F.coalesce("triples", F.array().cast(TRIPLES)), lambda t: ((tx.normalize_name(t["head"]) != "") & F.contains(asked, tx.normalize_name(t["head"]))) | ((tx.normalize_name(t["tail"]) != "") & F.contains(asked, tx.normalize_name(t["tail"]))))
    wordless = F.size(terms) == 0
    # the text decides first: evidence and triples are then looked up for few sentences
    rows = g["sentences"].select("sent_id", "doc_id", "text").join(instructions, "doc_id").where(wordless | F.exists(terms, lambda t: F.contains(norm, t)))
    rows = pinned(rows.select("instruction_id", "sent_id", "instruction", wordless.alias("wordless")))
    near = pv.around(g, rows.select("sent_id"))
    rows = pv.with_evidence(near, rows).join(pv.current_triples(near), "sent_id", "left")
    return rows.where(~F.col("wordless") | named).select("instruction_id", "sent_id")


def select_by_vectors(g: Graph, instructions: DataFrame, limit: int = 5, threshold: float | None = None) -> DataFrame:
    """The nearest sentences of the document, of which those without evidence are then left out."""
    queries = instructions.select(F.col("instruction_id").alias("query_id"), F.col("instruction").alias("query"), F.col("doc_id").alias("query_doc"))
    vectors = queries.where(tx.strip(F.col("query")) != "").select("query_id", retrieval.vx.hashed_embedding(F.col("query")).alias("query_vector"), "query_doc")
    rows = g["sentences"].select("sent_id", "doc_id", "embedding").join(F.broadcast(vectors), F.col("doc_id") == F.col("query_doc")).where("embedding is not null")
    scored = rows.select("query_id", "sent_id", retrieval.vx.cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    best = pv.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "sent_id")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return pv.with_evidence(g, top.select(F.col("query_id").alias("instruction_id"), "sent_id"))


def build_edits(
    g: Graph, instructions: DataFrame, *, provider: Provider | None = None, input_kind: str = "instruction", selector: str = "evidence", limit: int = 5, threshold: float | None = None,
    label_threshold: float = ontology.THRESHOLD,
) -> DataFrame:
    """Edits (with edit_seq) for all related sentences of each instruction's document. ``instructions``: instruction_id, doc_id, instruction.

    A sentence that the provider finds not concerned is skipped for a fact and
    kept as it is for an instruction.
    """
    if provider is None and input_kind == "fact":
        raise ValueError("facts need a provider")
    if selector not in ("evidence", "embedding"):
        raise ValueError("selector must be 'evidence' or 'embedding'")
    chosen = select_by_evidence(g, instructions, input_kind) if selector == "evidence" else select_by_vectors(g, instructions, limit, threshold)
    rows = chosen.join(instructions.select("instruction_id", "instruction"), "instruction_id").join(g["sentences"].select("sent_id", "doc_id", "idx", "text"), "sent_id").join(pv.current_triples(g), "sent_id", "left")
    rows = rows.withColumn("triples", F.coalesce("triples", F.array().cast(TRIPLES)))
    made = (provider or heuristic)(rows)
    if input_kind == "fact":
        made = made.where("applies")
    made = made.withColumns({"new_text": F.when(F.col("applies"), F.col("new_text")).otherwise(F.col("text")), "candidate": F.when(F.col("applies"), F.col("candidate")).otherwise(F.col("triples"))})
    made = made.withColumn("_key", tx.sentence_id(F.col("instruction_id").cast("string"), F.col("sent_id")))
    made = ontology.canonicalize(made, ontology.labels(g), key="_key", column="candidate", threshold=label_threshold)
    old = F.when(tx.is_replacement(F.col("instruction")), tx.superseded(F.col("triples"), F.col("instruction"))).otherwise(F.slice("triples", 1, 0))
    made = made.withColumn("intended_triples", verify(F.col("triples"), F.col("new_text"), F.col("candidate"), old))
    order = F.row_number().over(pv.Window.orderBy("instruction_id", "doc_id", "idx")) - 1
    return made.select(order.cast("long").alias("edit_seq"), "doc_id", F.col("idx").alias("sent_idx"), "new_text", "intended_triples", "instruction_id")


def gate(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Relevance answers (case_id, sentence_id, should_edit) in candidate order; unknown ids are ignored, a missing one is an error."""
    rows = candidates.join(answers.select("case_id", "sentence_id", F.col("should_edit").alias("answer")), ["case_id", "sentence_id"], "left")
    return rows.withColumn("answer", F.when(F.col("answer").isNull(), F.raise_error(F.concat(F.lit("no decision for "), "sentence_id")).cast("boolean")).otherwise(F.col("answer")))
