"""Single long lines that an earlier document has too."""

import corpus_pipeline


def test_long_lines_between_different_neighbours(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    texts = [long, f"a\n{long}\nb", f"c\n{short}\nd", f"e\n{short}\nf", long, "\n".join(["x", long, "y", long])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = dict(corpus_pipeline.drop_repeated_lines(spark, docs, "").select("doc_id", "text").collect())
    assert got == {0: long, 1: "a\nb", 2: texts[2], 3: texts[3], 4: "", 5: "x\ny"}
