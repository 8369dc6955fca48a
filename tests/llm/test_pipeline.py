"""The pipeline's stages against what their operators say, and on awkward rows."""

import corpus_pipeline as pipeline
from pergola.llm import decontaminate, jaccard_join, language_id
from pergola.llm._arrow import written


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "pii", "bpe_codec"]
    one = written(pipeline.languages(spark, docs, smallest))
    model = language_id.train(docs.where(language_id.remainder("doc_id", 4) != 2))
    assert ids(one) == sorted(r.doc_id for r in language_id.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5)
    two = written(pipeline.near_duplicates(spark, one, smallest))
    assert ids(two) == sorted(r.doc_id for r in jaccard_join.join(one, width=5, least=80).collect() if r.doc_id == r.component_id)
    three = written(pipeline.benchmark_passages(spark, two, smallest))
    bench = spark.read.parquet(f"{smallest}/benchmark.parquet")
    assert ids(three) == sorted(r.doc_id for r in decontaminate.contamination(two, bench).collect() if not r.contaminated)
    four = written(pipeline.personal_data(spark, three, smallest))
    assert ids(four) == ids(three) and four.where("n_chars <> length(text)").count() == 0
    assert one.columns == two.columns == three.columns == four.columns == list(docs.columns)
    five = pipeline.token_ids(spark, four, smallest)
    assert ids(five) == ids(four)
    assert {r.decoded_sha256 for r in five.collect()} == {r.s for r in four.selectExpr("sha2(text, 256) AS s").collect()}


def test_awkward_rows(spark, smallest, awkward):
    docs = awkward.select(*pipeline.COLUMNS)
    two = pipeline.near_duplicates(spark, docs, smallest)
    found = two.collect()
    assert sorted((r.doc_id for r in found), key=str) == [1, 10, 11, 12, 13, 4, 5, 6, 7, 8, 9, None]
    for stage in (pipeline.benchmark_passages, pipeline.personal_data):
        assert stage(spark, docs, smallest).count() <= docs.count()
        assert stage(spark, docs.limit(0), smallest).count() == 0
    assert pipeline.languages(spark, docs, smallest).where("text IS NULL").count() == 0
    assert pipeline.near_duplicates(spark, docs.limit(0), smallest).count() == 0
