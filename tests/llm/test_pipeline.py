"""The pipeline's stages, each on what the one before it left."""

import corpus_pipeline as C
import odd
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from runloom.llm import decontamination, simhash
from runloom.llm.batches import written


def test_stages_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        tables[name] = {r["doc_id"]: r for r in docs.collect()}
    start = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    sizes = [len(tables[n]) for n, _ in C.STAGES[:-1]]
    assert start > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    # What is left has no near-duplicates, no leaks and no addresses.
    kept = spark.createDataFrame(list(tables["benchmark"].values()), docs.schema)
    groups = simhash.query_rows(kept).groupBy("component_id").count()
    assert groups.where("count > 1").count() == 0
    assert decontamination.matches(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert not any("@mail" in r["text"] for r in tables["personal_data"].values())
    untouched = [i for i, r in tables["personal_data"].items() if r["text"] == tables["benchmark"][i]["text"]]
    assert len(untouched) > 0.7 * len(tables["personal_data"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(C.VOCABULARY))
    rows = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {
        i: tokenizer.encode(r["text"], add_special_tokens=False).ids
        for i, r in tables["personal_data"].items()}
    # run() is these stages one after the other.
    again = C.run(spark, sf_dir).collect()
    assert odd.keyed(again) == odd.keyed(rows)


def test_stages_take_odd_documents(spark, sf_dir):
    for docs in (odd.odd_documents(spark), odd.no_documents(spark)):
        rows = docs
        for _, stage in C.STAGES[:-1]:
            rows = written(stage(spark, rows, sf_dir), "odd")
            assert rows.columns == docs.columns
        done = C.STAGES[-1][1](spark, rows, sf_dir).collect()
        assert all(r["n_tokens"] == len(r["ids"]) for r in done)
        assert {r["doc_id"] for r in done} == ({1, 2, 4, 5, 7, 8, 10, None} if docs.count() else set())


def test_registered():
    names = set(entry_point.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and "op2_quotations" in entry_point.oracle_sql()
