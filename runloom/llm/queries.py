"""The operators' registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runloom.llm import (
    bpe_tables,
    byte_bpe,
    decontamination,
    licenses,
    main_text,
    neighbours,
    pii,
    quotations,
    search,
    simhash,
    token_files,
    toxicity,
    whitening,
)
from runloom.plans.registry import table
from runloom.session import scratch_dir

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` a test holds it against a plain version."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.query_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_quotations", quotations.ORACLE)
def op2_quotations(spark, sf_dir):
    return quotations.reply_order(table(spark, sf_dir, "conversations"))


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    path = scratch_dir(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path,
                                  public_tokenizers.path(VOCABULARY))
    return token_files.read_documents(spark, path)


@query("op4_neighbours")
def op4_neighbours(spark, sf_dir):
    return neighbours.query_rows(table(spark, sf_dir, "embeddings"))


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return simhash.query_rows(table(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark, sf_dir):
    return pii.query_rows(table(spark, sf_dir, "documents"))


@query("op7_licenses")
def op7_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_main_text")
def op8_main_text(spark, sf_dir):
    return main_text.query_rows(table(spark, sf_dir, "pages"))


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    return decontamination.matches(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "benchmark"))


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    return bpe_tables.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                              public_tokenizers.PATTERN)


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_search", search.ORACLE)
def op12_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                            public_tokenizers.PATTERN)
