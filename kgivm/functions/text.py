"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """White space (any) to single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def strip(c: Column) -> Column:
    """Trim any white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_hash(c: Column) -> Column:
    return F.sha1(c)


def safe_key(prefix: Column, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the parts' sha1."""
    return F.concat(prefix, F.lit("_"), F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(16)))


def edge_key(kind: str, src: Column, dst: Column) -> Column:
    return safe_key(F.lit(kind), src, dst)


def sentence_id(doc: Column, idx: Column) -> Column:
    return F.concat_ws(":", doc, idx)


def doc_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def in_doc(key: Column, doc: str | Column) -> Column:
    """Keys of one document; doc1 does not include doc10."""
    return F.startswith(key, F.concat(doc if isinstance(doc, Column) else F.lit(doc), F.lit(":")))


def cleanup(c: Column) -> Column:
    """Runs of blanks, doubled commas and empty brackets left by a removal."""
    one = strip(F.regexp_replace(c, r"(?U)\s{2,}", " "))
    return strip(F.regexp_replace(F.regexp_replace(one, r"(?U),\s*,", ","), r"(?U)\(\s*\)", ""))


def _quoted(phrase: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _first(text: Column, pattern: Column, new: Column) -> Column:
    """Replace the first match only; ``new`` is literal."""
    literal = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(text, F.concat(F.lit(r"(?s)^(.*?)(?U:"), pattern, F.lit(")")), F.concat(F.lit("$1"), literal))


def remove_phrase(text: Column, phrase: Column) -> Column:
    pattern = F.concat(F.lit(r"(?<!\w)\s*,?\s*"), _quoted(phrase), F.lit(r"\s*,?(?!\w)"))
    return cleanup(_first(text, pattern, F.lit(" ")))


def replace_phrase(text: Column, old: Column, new: Column) -> Column:
    pattern = F.concat(F.lit(r"(?<!\w)"), _quoted(old), F.lit(r"(?!\w)"))
    return cleanup(_first(text, pattern, new))


def phrase_occurs(text: Column, phrase: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)"), _quoted(phrase), F.lit(r"(?!\w)")))


# The wordings that an instruction may have.
REPLACE = r"(?i)\breplace\s+(.+?)\s+with\s+(.+)$"
REMOVE = r"(?i)\b(?:remove|delete|drop)\s+(.+)$"


def replaced(instruction: Column) -> tuple[Column, Column]:
    """The old and the new phrase of a replacement (empty: none)."""
    i = strip(instruction)
    return strip(F.regexp_extract(i, REPLACE, 1)), strip(F.regexp_extract(i, REPLACE, 2))


def dropped(instruction: Column) -> Column:
    return strip(F.regexp_extract(strip(instruction), REMOVE, 1))


def focus_terms(instruction: Column) -> Column:
    """Phrases that an instruction replaces or removes; both kinds can be present."""
    return F.filter(F.array(replaced(instruction)[0], dropped(instruction)), lambda t: t != "")


def is_replacement(instruction: Column) -> Column:
    return F.regexp_like(instruction, F.lit(r"(?is)\breplace\b.+\bwith\b"))


def superseded(triples: Column, instruction: Column) -> Column:
    """The triples that a replacement names by head, tail or whole fact."""
    old = strip(F.regexp_extract(instruction, r"(?is)\breplace\s+(.+?)\s+with\s+(.+)$", 1))
    old = F.regexp_replace(old, r"(?i)^the\s+old\s+fact\s+", "")
    old = strip(F.regexp_replace(F.regexp_replace(old, r"^['\"]+|['\"]+$", ""), r"\.+$", ""))
    old = normalize_name(old)
    named = lambda t: (normalize_name(t["head"]) == old) | (normalize_name(t["tail"]) == old) | (normalize_name(F.concat_ws(" ", t["head"], t["rel_type"], t["tail"])) == old)
    return F.when(old != "", F.filter(triples, named)).otherwise(F.slice(triples, 1, 0))


def label_norm(c: Column) -> Column:
    """Normalised label without final full stops."""
    return F.regexp_replace(normalize_name(c), r"\.+$", "")


def changed_value(old: Column, new: Column) -> Column:
    """struct(old, new): what differs after the common beginning, cut at a blank."""
    chars = F.sequence(F.lit(1), F.least(F.length(old), F.length(new)))
    same = F.coalesce(F.array_max(F.filter(chars, lambda i: F.substring(old, F.lit(1), i) == F.substring(new, F.lit(1), i))), F.lit(0))
    same = F.when(F.least(F.length(old), F.length(new)) == 0, F.lit(0)).otherwise(same)
    head = F.substring(old, F.lit(1), same)
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    start = F.when(F.instr(head, " ") > 0, cut + 1).otherwise(F.lit(0))
    return F.struct(strip(F.substring(old, start + 1, F.length(old))).alias("old"), strip(F.substring(new, start + 1, F.length(new))).alias("new"))


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Rounded quotient; null for a zero denominator."""
    return F.when(denominator != 0, F.round(numerator / denominator, digits))


def share(numerator: Column, denominator: Column) -> Column:
    """Quotient; 0.0 for a zero denominator."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def percent_reduction(ours: Column, other: Column) -> Column:
    return F.when(other != 0, F.round((1 - ours / other) * 100, 2))


def as_int(c: Column) -> Column:
    """A lenient integer: whole numbers as they are, decimal and exponent forms without their fraction, 0 for anything else."""
    value = F.trim(c.cast("string"))
    number = value.try_cast("double")
    whole = F.when(F.abs(number) < 2.0**63, number.try_cast("long"))
    return F.coalesce(F.try_to_number(value, F.lit("S9999999999999999999")).try_cast("long"), whole, F.lit(0).cast("long"))


def is_property_id(c: Column) -> Column:
    return c.rlike("^P[0-9]+$")


def fact_query(head: Column, rel: Column, tail: Column) -> Column:
    return F.concat(F.concat_ws(" ", head, rel, tail), F.lit("."))


def json_object(c: Column) -> Column:
    """The outermost braces of a model's answer, without code fences."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def triples_of_json(c: Column) -> Column:
    """Well-formed, non-blank triples of a JSON array of three-element arrays."""
    rows = F.coalesce(F.from_json(c, "array<array<string>>"), F.array().cast("array<array<string>>"))
    whole = F.filter(rows, lambda r: F.coalesce((F.size(r) == 3) & F.forall(r, lambda x: F.coalesce(strip(x) != "", F.lit(False))), F.lit(False)))
    return F.transform(whole, lambda r: F.struct(strip(r[0]).alias("head"), strip(r[1]).alias("rel_type"), strip(r[2]).alias("tail")))
