from collections import Counter, defaultdict

from conftest import SF, duck_rows, rows

from quillgrid.llm import mixing, queries, sharding


def test_mix_equals_sql(spark, duck):
    columns, wanted = duck_rows(duck, mixing.SQL)
    out = queries.op2_mixing(spark, SF)
    assert sorted(out.columns) == columns and rows(out) == wanted


def test_water_filling(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    out = {r.source: r.target for r in mixing.targets(sources, 1.5 * 1510).collect()}
    assert out["a"] == 20 and out["c"] == 0
    assert abs(sum(out.values()) - 2265) < 1e-9
    # b weighs 2, c 1 (clamped), the null source 5 (clamped at 1000)
    assert out[None] == 1000 and abs(out["b"] - 1245) < 1e-9


def test_taken_words_come_near_the_targets(spark):
    import random

    rng = random.Random(4)
    data = [(i, "w " * rng.randint(0, 400), ["hot", "hot", "b", "c", None][i % 5]) for i in range(1500)] + [(9999, None, "hot"), (None, "x y", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 as bucket", "2 as budget")
    out = mixing.mix(docs).collect()
    assert len(out) == len(data) and rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(7)))
    got, goal = defaultdict(int), {}
    for r in out:
        got[(r.source_size, r.target)] += r.taken
        goal[(r.source_size, r.target)] = r.target
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(abs(got[k] - goal[k]) <= 0.01 * goal[k] + 5 for k in goal)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id = 9999")).collect()] == [0]


def check_shards(out, n, shards):
    counts = Counter(r.shard for r in out)
    assert len(out) == n and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in out)


def test_shards_of_documents(spark, duck):
    out = queries.op6_sharding(spark, SF).collect()
    n = duck.sql("select count(*) from documents").fetchall()[0][0]
    check_shards(out, n, 24)
    sizes = dict(duck.sql("select doc_id, octet_length(encode(text)) + 8 from documents").fetchall())
    assert {r.doc_id: r.size for r in out} == sizes
    groups = defaultdict(set)
    for doc_id, key in duck.sql("select doc_id, text from documents").fetchall():
        groups[key].add(next(r.shard for r in out if r.doc_id == doc_id))
    assert sum(len(g) - 1 for g in groups.values()) <= 2


def test_shards_with_a_huge_group_and_edges(spark):
    import zlib

    data = [(i, "copy") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(300)] + [(2000 + i, f"single {i}") for i in range(301)]
    data += [(None, None), (None, ""), (5000, None), (5001, "é"), (5001, "é")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 as g", "2 as cell", "3 as shard")
    out = sharding.shard(docs, shards=6).collect()
    check_shards(out, len(data), 6)
    assert {r.size for r in out if r.doc_id == 5000} == {8} and {r.text_crc32 for r in out if r.doc_id == 5001} == {zlib.crc32("é".encode())}
    copies = Counter(r.shard for r in out if r.doc_id is not None and r.doc_id < 400)
    assert len(copies) <= 4  # three shards hold 400 of 1007 rows
    split = sum(1 for i in range(150) if len({r.shard for r in out if r.doc_id in (1000 + 2 * i, 1001 + 2 * i)}) > 1)
    assert split <= 3
    assert sharding.shard(docs.limit(0)).count() == 0
    check_shards(sharding.shard(docs.where("doc_id < 400"), shards=7).collect(), 400, 7)


def test_rows_that_repeat_an_id_count_each(spark, duck):
    text = "w " * 10
    docs = spark.createDataFrame([(1, text, "a")] * 101 + [(2, "x " * 4, "a")], "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == 102 and out[0].target == 1521
    assert abs(sum(r.taken for r in out) - 1521) <= 10
    duck.register("repeated", docs.toPandas())
    wanted = duck.sql(f"select sum(taken) from ({mixing.SQL.replace('from documents', 'from repeated')})").fetchall()[0][0]
    assert sum(r.taken for r in out) == wanted


def test_a_long_document_is_passed_over(spark):
    for seed in range(3):
        docs = spark.createDataFrame([(i, "w " * 100, "a") for i in range(1000)] + [(7000, "w " * 60_000, "a")], "doc_id long, text string, source string")
        out = mixing.mix(docs, total=1.3, seed=seed).collect()
        assert abs(sum(r.taken for r in out) - out[0].target) <= 100


def test_rounds_of_filling_are_a_greedy_walk(spark):
    import random

    rng = random.Random(9)
    data = [(i, "w " * int(rng.paretovariate(0.7)), f"s{i % 4}") for i in range(800)]
    docs = spark.createDataFrame([(i, t[:40_000], s) for i, t, s in data], "doc_id long, text string, source string")
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns, wanted = duck_rows(con, mixing.SQL)
    assert rows(mixing.mix(docs)) == wanted


def least_cut(sizes, quotas):
    """The fewest parts beyond one of each text, over all ways to fill the quotas."""
    from functools import cache

    @cache
    def best(i, room):
        if i == len(sizes):
            return 0
        found = []

        def place(shard, left, parts, rest):
            if left == 0:
                found.append(parts - 1 + best(i + 1, tuple(sorted((*rest, *room[shard:])))))
            elif shard < len(room):
                for n in range(min(left, room[shard]) + 1):
                    place(shard + 1, left - n, parts + (n > 0), (*rest, room[shard] - n))

        place(0, sizes[i], 0, ())
        return min(found)

    return best(0, tuple(sorted(quotas)))


def test_cut_against_brute_force(spark):
    import random

    rng = random.Random(21)
    for _ in range(6):
        sizes = [rng.randint(1, 5) for _ in range(rng.randint(2, 6))]
        data = [(1000 * g + i, f"text {g} {rng.random()}" if n == 1 else f"text {g}") for g, n in enumerate(sizes) for i in range(n)]
        out = sharding.shard(spark.createDataFrame(data, "doc_id long, text string"), shards=3).collect()
        check_shards(out, len(data), 3)
        parts = {(r.doc_id // 1000, r.shard) for r in out}
        total = len(data)
        wanted = least_cut(tuple(sizes), tuple(total // 3 + (s < total % 3) for s in range(3)))
        assert wanted <= len(parts) - len(sizes) <= 2
