"""Table schemas of the maintained graph."""

from __future__ import annotations

TRIPLE = "struct<head:string,rel_type:string,tail:string>"
TRIPLES = f"array<{TRIPLE}>"
EVIDENCE = "struct<entity:string,surface:string,head:string,rel_type:string,tail:string,head_id:string,tail_id:string>"

TABLES = {
    "documents": "doc_id string, title string, num_sents int, source string",
    "sentences": "sent_id string, doc_id string, idx int, text string, text_hash string, status string, last_changed_step int, embedding array<double>, embedding_backend string",
    "entities": "entity_id string, doc_id string, name string, norm_name string, type string, evidence_count long, freshness_status string, last_changed_step int",
    "relations": "relation_id string, doc_id string, head string, tail string, rel_id string, rel_type string, evidence_count long, freshness_status string, status string, last_changed_step int",
    "mentions": "edge_id string, src string, dst string, surface string, status string, added_step int, removed_step int",
    "sentence_supports_relation": "edge_id string, src string, dst string, rel_type string, status string, added_step int, removed_step int",
    "evidence_deltas": f"step int, edit_seq long, sent_id string, scope string, delta_type string, target_id string, triple {EVIDENCE}, reason string, position int",
    "refresh_decisions": "step int, edit_seq long, target_type string, target_id string, decision string, reason string, cost int, status string, position int",
}
EDIT = f"edit_seq long, doc_id string, sent_idx int, new_text string, intended_triples {TRIPLES}"
DOCUMENT_TABLES = ("documents", "sentences", "entities", "relations", "evidence_deltas", "refresh_decisions")
EDGE_TABLES = ("mentions", "sentence_supports_relation")
