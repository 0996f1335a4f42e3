from collections import Counter

from conftest import SF

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_without_or_with_repeated_ids_stay(spark):
    texts = [f"{a} tells of {b} and {c} on day {i}" for i, (a, b, c) in enumerate([("ann", "rivers", "hills"), ("bob", "ships", "ropes"), ("cy", "bread", "salt"), ("di", "wool", "looms")])]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (9, texts[1]), (None, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()) == sorted([(True, 0, texts[0]), (False, 9, texts[1]), (False, 7, texts[2]), (False, 7, texts[3])])


def test_mix_does_not_multiply_repeated_ids(spark):
    data = [(1, f"word{i} " * 5) for i in range(40)] + [(None, f"other{i} " * 5) for i in range(40)] + [(2, "same same same same same")] * 3
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], SCHEMA)
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert set(out) == set(data)
    most = Counter(data)
    assert all(n <= 2 * most[k] for k, n in out.items())
    assert abs(5 * sum(out.values()) - 1.5 * 5 * len(data)) <= 15
