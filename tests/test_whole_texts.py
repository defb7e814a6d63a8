from newsweave.plans.registry import QUERIES


def test_words_far_into_a_text_count(spark, tmp_path):
    far = "x " * 60
    rows = [(0, far + "ment", 124), (1, far + "que ung", 127), (2, far + "x", 121), (3, far + "7 ca mắc", 128)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    read = lambda name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert read("keyword_match_whole") == {(0, "ment"), (1, "ung"), (2, ""), (3, "")}
    assert read("keyword_exclusion_whole") == {(0,), (2,), (3,)}
    assert read("keyword_explode_counts_whole") == {("ment", 1), ("ung", 1)}
    assert read("primary_disease_whole") == {(0, "ment"), (1, None), (2, None), (3, None)}
    assert (3, 7) in read("case_count_extract_whole")
