import corpus_pipeline
from pyspark.sql import functions as F

from cinderlog.llm import toxicity
from cinderlog.llm.quality import op10_quality

INSULTS = "you are a pathetic moron, an idiot and a worthless clown"


def planted(spark, sf, folder, n=20):
    """The tables of sf with toxic copies of good documents, half of them labelled."""
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    good = labels.where("quality = 1 and toxic = 0").join(docs, "doc_id").where("n_chars between 300 and 3000 and lang = 'en'")
    rows = good.orderBy("doc_id").limit(n).select(
        (F.col("doc_id") + 1_000_000).alias("doc_id"),
        F.concat_ws("\n", F.lit("a toxic copy"), F.reverse(F.split("text", " ")).cast("string"), F.lit(INSULTS)).alias("text"),
        "lang", "source", F.length("text").cast("long").alias("n_chars"),
    )
    docs.unionByName(rows).write.parquet(f"{folder}/documents.parquet")
    told = rows.where("doc_id % 2 = 0").select("doc_id", F.lit(1).cast("int").alias("quality"), F.lit(1).cast("int").alias("toxic"))
    labels.unionByName(told).write.parquet(f"{folder}/labels.parquet")


def test_planted_toxic_documents_go(spark, tmp_path):
    planted(spark, "/root/testdata/sf0.01", tmp_path)
    kept = {r.doc_id for r in op10_quality(spark, str(tmp_path)).where("kept").collect()}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.quality and not r.toxic]
    assert not [i for i in kept if i >= 1_000_000]
    assert sum(i in kept for i in clean) > 0.98 * len(clean)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.without_repeated_lines(spark, docs, str(tmp_path)).where("doc_id >= 1000000").count() == 0


def test_marks_on_labels_kept_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    marks = toxicity.learn(docs, labels.where(~hidden))
    got = docs.withColumn("p", toxicity.probability(marks)).join(labels.where(hidden), "doc_id").collect()
    toxic, clean = ([r.p >= 0.5 for r in got if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 90 and sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.02 * len(clean)


def test_nulls_and_labels_of_one_kind(spark):
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x"), (2, "x")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    for labels in (one, one.limit(0)):
        marks = toxicity.learn(odd, labels)
        assert [r.p for r in odd.select(toxicity.probability(marks).alias("p")).collect()] == [0.0] * 4
    few = toxicity.Marks({"moron": 5.0, "heel+": 5.0}, -2.0)
    rows = spark.createDataFrame([("A MORON!",), ("heel heel",), ("heel, heel heel",), (None,)], "text string")
    assert [r.p > 0.5 for r in rows.select(toxicity.probability(few).alias("p")).collect()] == [True, False, True, False]
