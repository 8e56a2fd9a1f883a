"""The pipeline at the repository top, and the registration of all queries of the subpackage."""

import re

import corpus_pipeline
from llm_cases import documents, empty_like
from pyspark.sql import functions as F

import __spark_entry__ as entry

from ledgerloom.llm import bpe, decontam, linerun, simhash, toxicity
from ledgerloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_stages_equal_their_operators(spark):
    """Each stage on what its predecessor wrote: rows kept, columns, and agreement with the operator's verdicts."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))

    def ids(df):
        return sorted(r.doc_id for r in df.collect())

    kept = docs
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, [
            lambda d: ids(toxicity.toxicity(d, labels).filter("NOT rejected")),
            lambda d: ids(d),
            lambda d: sorted({r.component_id for r in simhash.near_duplicates(d).collect()}),
            lambda d: ids(decontam.contamination(d, items).filter("NOT contaminated")),
            lambda d: ids(d)]):
        result = stage(spark, kept, FOLDER)
        path = corpus_pipeline.work_folder(spark, "test")
        result.write.parquet(path)
        result = spark.read.parquet(path)
        assert ids(result) == wanted(kept), name
        if name == "lines":
            hashes = {(r.doc_id, r.text_sha256) for r in linerun.line_digests(kept).collect()}
            assert {(r.doc_id, r.h) for r in result.selectExpr("doc_id", "sha2(text, 256) AS h").collect()} == hashes
            assert result.filter("n_chars <> char_length(text)").count() == 0
        if name != "tokens":
            assert result.columns == docs.columns, name
        else:
            assert sorted(result.collect()) == sorted(bpe.round_trip(kept, bpe.default_path()).collect())
        kept = result
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted(run.collect()) == sorted(kept.collect())


def test_stages_on_odd_and_empty_tables(spark):
    """Null and repeated ids, odd texts, and a column whose name holds a dot; all columns stay up to the last stage."""
    odd = documents(spark).withColumn("a.b", F.lit(1))
    for docs in (odd, empty_like(odd)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, FOLDER)
            path = corpus_pipeline.work_folder(spark, "odd")
            result.write.parquet(path)
            result = spark.read.parquet(path)
            assert result.count() <= n and (name == "tokens" or result.columns == odd.columns), name
            if name in ("lines", "tokens"):
                assert result.count() == docs.count()
            docs = result
        assert (docs.count() > 0) == (n > 0)
