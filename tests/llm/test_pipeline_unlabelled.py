from conftest import SF

import corpus_pipeline


def test_unlabelled_documents_with_letters_stay(spark):
    data = [(1, "the cat sat"), (2, "été"), (3, "12 - 34"), (4, ""), (5, None), (None, "a dog")]
    docs = spark.createDataFrame([(i, t, None, "a", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} == {"the cat sat", "été", "a dog"}
