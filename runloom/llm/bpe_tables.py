"""BPE over a table of documents: ids, and the text that they decode to."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runloom.llm.batches import (
    flat_computed,
    fresh,
    name_column,
    text_column,
    whole_texts,
    with_computed,
)
from runloom.llm.bpe import bpe_for


def encode_documents(docs: DataFrame, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """``docs`` plus a column of ids of every whole text.

    A null text is empty and has no ids. All columns and rows stay; if ``into`` is taken, the new
    column gets underscores at its end.
    """
    out = fresh(docs, into)
    field = T.StructField(out, T.ArrayType(T.IntegerType()))

    def start():
        bpe = bpe_for(path, pattern)
        memory = bpe.memory()

        def work(texts):
            ids = bpe.encode(whole_texts(texts), memory)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        return work

    return with_computed(docs, ["text"], [field], start)


def decode_ids(rows: DataFrame, ids: str, path: str, pattern: str, into: str = "text") -> DataFrame:
    """``rows`` plus the text of a column of ids; null ids are an empty text."""
    out = fresh(rows, into)

    def start():
        bpe = bpe_for(path, pattern)
        return lambda lists: [[bpe.decode(some or []) for some in lists]]

    return with_computed(rows, [ids], [T.StructField(out, T.StringType())], start)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and the decoded text's decoded_sha256.

    A null text is empty. Rows stay apart, repeated ones too; a null doc_id stays null.
    """
    rows = docs.select(name_column("doc_id").alias("doc_id"), text_column().alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def start():
        bpe = bpe_for(path, pattern)
        memory = bpe.memory()

        def work(doc_ids, texts):
            sizes, ids_digests, text_digests = [], [], []
            for ids in bpe.encode(texts, memory):
                some = ids.tolist()
                sizes.append(len(some))
                ids_digests.append(hashlib.sha256(bpe.decimals(some)).hexdigest())
                raw = bpe.decode_bytes(some)
                # Only bytes that are valid UTF-8 stay as they are.
                text_digests.append(hashlib.sha256(
                    raw.decode("utf-8", "replace").encode()).hexdigest())
            return doc_ids, sizes, ids_digests, text_digests
        return work

    return flat_computed(rows, fields, start)
