import corpus_pipeline as P


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = d, d.columns
    from lodestack.llm.common import staged

    for name, stage in P.STAGES[:-1]:
        out = staged(stage(spark, kept, sf), name)
        assert out.columns == columns
        assert out.join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0
        kept = out
    last = P.STAGES[-1][1](spark, kept, sf)
    assert last.count() == kept.count() and last.where("not round_trip").count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "A B C D", "en", "s", 7), (None, "a b c d", "en", "s", 7), (3, None, "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in P.keep_one_of_each(spark, d, "").collect()) == [1, 3]
