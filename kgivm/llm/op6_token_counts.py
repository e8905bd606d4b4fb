"""Token counts with a whole-token shortcut.

``whole_tokens`` proves once, before the job, which vocabulary strings encode
alone as a single token: each such string is run through the merges. The result
(at most one entry per vocabulary entry) is a read-only table of fingerprints and
ids that is sent to the tasks and never evicted, so matching pre-tokens count as
one without merging; only the rest is merged, and kept in a cache of its own.

Null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row;
extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.llm.pretokens import encoder, string_prints

OVER = 1024


def whole_tokens(path: str, style: str = "byte") -> dict[str, int]:
    """Vocabulary strings that, standing alone as a pre-token, encode to exactly one token, and its id."""
    from kgivm.llm.pretokens import VISIBLE, Encoder

    enc = Encoder(path, style)
    plain = {chr(v): k for k, v in VISIBLE.items()}
    merge = enc.lib.model.tokenize
    proven = {}
    for token in enc.lib.get_vocab(with_added_tokens=False):
        if token.endswith("</w>"):
            token = token[:-4]
        try:
            text = bytes(plain.get(c, ord(c)) for c in token).decode()
        except (UnicodeDecodeError, ValueError):
            continue
        # merged as the pre-token that stands in a text
        got = merge(text.encode().decode("latin-1").translate(VISIBLE))
        if text and len(got) == 1 and len(enc.lib.pre_tokenizer.pre_tokenize_str(text)) == 1:
            proven[text] = got[0].id
    return proven


def proven_table(path: str, style: str = "byte") -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints and ids of the proven strings."""
    proven = whole_tokens(path, style)
    prints = string_prints(list(proven))
    order = np.argsort(prints)
    return prints[order], np.fromiter(proven.values(), np.int32, len(proven))[order]


def token_counts(docs: DataFrame, path: str, *, style: str = "byte", text: str = "text", key: str = "doc_id", limit: int = OVER) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    prints, ids = proven_table(path, style)

    def count(batches):
        enc = encoder(path, style)
        if len(enc.proven) != len(prints):
            enc.seed(prints, ids)
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            column = batch.column(1)
            for lo, hi, _, bounds in enc.batches(column, ids=False):
                tokens[lo:hi] = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens)], ["k", "n_tokens"])

    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    rows = src.withColumn("b", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long"))

    def both(batches):
        for batch in batches:
            (out,) = count([batch.select(["k", "t"])])
            yield pa.RecordBatch.from_arrays([out.column(0), batch.column(2), out.column(1)], ["k", "n_bytes", "n_tokens"])

    got = rows.mapInArrow(both, f"k {kind}, n_bytes long, n_tokens long")
    return got.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
