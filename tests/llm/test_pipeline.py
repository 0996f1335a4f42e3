import re

from conftest import SF

import corpus_pipeline
from quillgrid.llm import decontaminate, language_id
from quillgrid.llm.common import table

from test_similar import brute


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "language_id":
            net = language_id.train(table(spark, SF, "documents"))
            scores = dict(zip(before, net.predict([(r.text or "").encode() for r in before.values()])))
            lettered = {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
            wanted = {i for i in lettered if scores[i][1] >= net.least}
            assert {r.doc_id for r in kept[name]} == wanted and len(lettered - wanted) <= 0.01 * len(lettered)
        if name == "near_dedup":
            assert {r.doc_id for r in kept[name]} == {first for _, first in brute([(i, r.text) for i, r in before.items()])}
        if name == "decontamination":
            again = decontaminate.contamination(docs, table(spark, SF, "benchmark")).collect()
            assert not any(r.contaminated for r in again)
            found = decontaminate.contamination(spark.createDataFrame(list(before.values()), docs.schema), table(spark, SF, "benchmark")).collect()
            dropped = {r.doc_id for r in found if r.n_hit and r.n_hit >= 0.5 * r.n_words}
            assert {r.doc_id for r in kept[name]} == before.keys() - dropped
            clean = {r.doc_id for r in found if not r.contaminated}
            assert all(r == before[r.doc_id] for r in kept[name] if r.doc_id in clean)
            assert all(r.n_chars == len(r.text) for r in kept[name])
        if name == "mixing":
            words = lambda rs: sum(len(r.text.split()) for r in rs)
            assert abs(words(kept[name]) - 1.5 * words(before.values())) < 0.03 * words(before.values())
        if name == "sharding":
            assert len(kept[name]) == len(kept["mixing"])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "shard" in out.columns


def test_columns_and_edges(spark):
    data = [(1, None, None, None, None), (1, "", "en", "a", 0), (2, "the cat sat on the mat", "en", None, 22), (2, "the cat sat on the mat", "en", None, 22), (None, "the dog ran to the park", "en", "a", 23)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
            frame.count()
