from collections import defaultdict

from quillgrid.llm import sharding


def divided(spark, texts, copies, shards=24):
    docs = spark.range(texts * copies).selectExpr("id as doc_id", f"concat('text ', id % {texts}) as text")
    out = sharding.shard(docs, shards).collect()
    held, counts = defaultdict(set), defaultdict(int)
    for r in out:
        held[r.doc_id % texts].add(r.shard)
        counts[r.shard] += 1
    assert len(out) == texts * copies and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == shards
    return sum(len(s) > 1 for s in held.values())


def test_tables_of_copies_only_stay_whole(spark):
    assert divided(spark, 6000, 2) <= 23
    assert divided(spark, 2000, 5) <= 23
