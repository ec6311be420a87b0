import pytest

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == names, name
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert tokens.filter("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() == seen[4] == tokens.count()


def test_empty_and_odd_documents(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, fp string, size string, ids string"
    text = " ".join(f"w{i}" for i in range(50)) + "."
    rows = [(None, None, None, None, None, 1, "f", "s", "i"), (1, text, "en", None, 9, 1, "f", "s", "i"), (1, text, "en", None, 9, 1, "f", "s", "i"),
            (2, text.replace("w40", "v40"), "en", "a", 9, 1, "f", "s", "i"), (None, text + " and more words", None, "a", 0, None, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == schema.replace(",", "").split()[::2]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert (out.count() > 0) == (n > 0)


@pytest.mark.parametrize("stage", [1])
def test_one_document_of_each_component_stays(spark, stage):
    import corpus_pipeline

    from neurotab.llm.simhash import near_duplicates

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.STAGES[stage][1](spark, docs, SMALL)
    want = {r["component_id"] for r in near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
