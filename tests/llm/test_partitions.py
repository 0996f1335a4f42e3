"""Loops keep the number of partitions, also where Spark merges none of them."""

from pyspark.sql import functions as F

from quillgrid.llm import components, similar


def most_partitions(monkeypatch, module, run):
    """The partitions of the largest checkpoint that `module` makes."""
    seen, cut = [], module.cut

    def counted(df):
        out = cut(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "cut", counted)
    run()
    assert len(seen) > 4
    return max(seen)


def held(spark, run):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_components_of_a_path_keep_their_partitions(spark, monkeypatch):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = []
    most = held(spark, lambda: most_partitions(monkeypatch, components, lambda: found.extend(components.connected_components(links).collect())))
    assert most <= 4 and {r.root for r in found} == {0} and len(found) == 301


def test_a_state_keeps_its_partitions_over_rounds(spark, monkeypatch):
    rows = [(k, bytes([g // 256, g % 256]), 1, bytes([g // 256, g % 256])) for k in range(4) for g in range(k, 1200, 1 if k == 0 else 2)]
    state = spark.createDataFrame(rows, "key long, g binary, n int, root binary")

    def rounds():
        now = state
        for _ in range(4):
            now = similar._open(now)
        assert now.count() == len(rows)

    assert held(spark, lambda: most_partitions(monkeypatch, similar, rounds)) <= 4
