from opinara.llm import labelled, quality, toxicity


def test_the_bound_is_of_rows_however_often_an_id_is_repeated(spark):
    docs = spark.range(50_000).selectExpr("id % 3 doc_id", "concat('text ', id % 7) text").unionAll(spark.range(10, 40).selectExpr("id", "cast(null as string)"))
    labels = spark.range(40).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    for per_class in (1, 5):
        rows = labelled.labelled_texts(docs, labels, "quality", per_class, 3, 1).collect()
        assert len(rows) == len({r.doc_id for r in rows}) <= 2 * per_class
    assert labelled.labelled_texts(docs, labels, "quality", 100, 3, 1).where("text is null").count() > 0


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("1", "you idiot"), ("x", "fine day"), (None, None)], "doc_id string, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, toxicity.train(docs, labels)).collect()
    assert sorted((r.doc_id is None, r.predicted) for r in got)[0][0] is False and len(got) == 3
    assert quality.classify(docs, None).count() == 3
