"""Operator 1: token counts by rank-synchronous array merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.llm.bpe import encoder
from blockloom.llm.common import emit, id_and_text, slices, texts_of

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count byte-level BPE tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One scan without a shuffle; memory is a slice of a batch and a bounded word memory.
    Null text: empty, 0 tokens. Null ids, repeated rows and any other columns of docs:
    one output row for each input row, with only the four columns above. Empty table: empty result.
    """

    def run(batches):
        for b in slices(batches):
            texts = texts_of(b)
            n = encoder(tokenizer_path).counts(texts)
            yield emit(SCHEMA, doc_id=b.column("doc_id"), n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=[x > limit for x in n])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
