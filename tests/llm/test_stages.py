"""The pipeline's filtering stages on planted rows with null and repeated doc_ids."""

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def test_cut_repeats_by_rows(spark):
    shared = "".join(f"{k:03d}-abc " for k in range(40))
    rows = [(1, "first " + shared), (None, "second one " + shared), (1, "short"), (3, None), (4, ""), (5, "same text " * 40), (None, "same text " * 40)]
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in P.cut_repeats(spark, table(spark, rows), "").collect())
    assert got == [(0, "second one", 10), (1, "first", 5), (1, "short", 5), (3, "", 0), (4, "", 0)]
    assert P.cut_repeats(spark, table(spark, rows).limit(0), "").count() == 0


def test_drop_leaks_by_rows(spark, tmp_path):
    item = "one of the questions of the benchmark asks how many grey geese fly over the lake in a year of little rain"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"so it says {item} at last"), (1, "a clean text of the same id"), (None, item), (None, "clean too"), (2, None)]
    got = sorted((r.doc_id or 0, r.text or "") for r in P.drop_leaks(spark, table(spark, rows), str(tmp_path)).collect())
    assert got == [(0, "clean too"), (1, "a clean text of the same id"), (2, "")]
