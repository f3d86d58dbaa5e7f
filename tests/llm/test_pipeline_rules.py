import corpus_pipeline


def test_one_repeated_line_in_a_short_text_is_left_to_the_classifier(spark):
    line = "the ramp to the bridge is closed for snow"
    rows = [(1, f"{line}\n{line}\nand it opens at noon"), (2, f"{line} " * 8), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in corpus_pipeline.quality_rules_stage(spark, df, "/nowhere").select("doc_id").collect()] == [1]
