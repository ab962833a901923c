import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_return_documents(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_first_stages_only_drop(spark, docs):
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = [r["doc_id"] for r in stage(spark, docs, SF).select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids and left, name


def test_one_document_of_each_group(spark, docs):
    from evidentia.llm import jaccard_join

    groups = jaccard_join.near_duplicates(docs)
    want = {r[0] for r in groups.select("component_id").distinct().collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_run_packs_every_token(spark):
    out = corpus_pipeline.run(spark, SF).cache()
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert fill.filter("n <> e or n > 1024").count() == 0 and out.count() > 0


def test_stages_on_awkward_and_empty_tables(spark):
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(None, None, None, None, 1), (1, None, "en", "s", 2), (2, "", None, "s", 3), (3, " \n", "en", None, 4), (4, "the ship left the harbour at dawn and nobody saw", "en", "s", 5), (4, "the ship left the harbour at dawn and nobody saw", "en", "s", 5), (5, long, "en", "t", 6), (None, "a text that has no id but has words of its own", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit(1)).withColumn("cls", F.lit("x"))
    want = {"line_dedup": 8, "near_duplicates": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        n = out.count()
        assert n == want.get(name, n) and n > 0, name
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns == none.columns


def test_remnants_of_near_copies_go_with_the_lines(spark):
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:290], *[f"v{i}" for i in range(10)]])), (3, " ".join([*words[:100], *[f"u{i}" for i in range(200)]]))], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert set(left) == {1, 3} and left[3].split() == [f"u{i}" for i in range(200)]
