import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from cinderlog.llm.queries import LLM_QUERIES
from cinderlog.llm.tokens import encoder, public_tokenizer


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, before = docs.count(), docs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert len(ids) <= rows and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality":
            assert all(labels[i] for i in ids if i in labels)
            assert len([i for i in ids if labels.get(i)]) == sum(labels.values())
        if name == "line_dedup":
            seen = [x.strip(" ") for r in after.collect() for x in r.text.split("\n")]
            long = [x for x in seen if len(x) >= 30]
            assert len(long) == len(set(long))
            assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    total = pieces.agg(F.sum("length")).first()[0]
    assert total == pieces.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    code, parts = encoder(public_tokenizer()), {}
    for r in pieces.collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for r in before.collect():
        assert b"".join(ids for _, ids in sorted(parts[r.doc_id])) == code.packed(r.text) + bytes(4)


def test_stages_take_nulls_and_empty_tables(spark, sf):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0)],
        spark.read.parquet(f"{sf}/documents.parquet").schema,
    )
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).count() == rows.count()
        corpus_pipeline.STAGES[-1][1](spark, rows, sf).count()


def test_columns_of_the_users_named_like_ours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["_quality", "_before", "row_key", "_row_key", "_stay", "quality_score", "_harmless"]
    more = docs.select("*", *[F.col("doc_id").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf).cache()
        assert out.columns == more.columns
        assert out.where(" or ".join(f"{n} <> doc_id" for n in names)).count() == 0
    corpus_pipeline.STAGES[-1][1](spark, more, sf).count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
