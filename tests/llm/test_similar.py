import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import similar


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """Smallest id of each row's component by comparing all texts with all."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        both = len(x & y)
        either = len(x) + len(y) - both
        if either == 0 or both >= 0.8 * either:
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, (key, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), key), key)
    return sorted((key, least[top(i)]) for i, (key, _) in enumerate(sets))


def found(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.component_id) for r in similar.similar_documents(docs, **kw).collect())


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("crowd", [64, 2])
def test_brute_force(spark, crowd):
    rng = random.Random(3)
    texts = []
    for size in (12, 40, 90, 300):
        base = [f"a{rng.randrange(5000)}" for _ in range(size)]
        texts += near_copies(rng, base, 14, max(1, size // 25))
        texts += near_copies(rng, base[: int(size * 0.85)], 6, max(1, size // 30))
    texts += [" ".join(f"b{rng.randrange(50)}" for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts += [texts[0], texts[5].upper(), "", None, "  \n", "one two", "one two", "one three"]
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    expected = brute(rows)
    assert len({c for _, c in expected}) < len(rows) - 20
    assert found(spark, rows, crowd=crowd) == expected


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.component_id) for r in similar.similar_documents(docs).collect()) == brute(rows)


def test_edges(spark):
    rows = [(None, "same text here"), (4, "same text here"), (None, "alone"), (9, "x" * 50_000), (9, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, g int, key string")
    out = sorted(((r.doc_id, r.component_id) for r in similar.similar_documents(docs).collect()), key=repr)
    assert out == sorted([(None, 4), (4, 4), (None, None), (9, 9), (9, 9)], key=repr)
    assert similar.similar_documents(docs.limit(0)).collect() == []


def test_estimated_sizes_stay_small_over_rounds(spark):
    from quillgrid.llm.common import cut

    state = spark.range(20).selectExpr("id", "id as root")
    for _ in range(6):
        state = cut(state.join(state.select(F.col("id").alias("root"), F.col("root").alias("top")), "root").select("id", F.col("top").alias("root")))
    assert state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert {tuple(r) for r in state.collect()} == {(i, i) for i in range(20)}


def test_a_filter_of_bits_keeps_all_that_is_wanted(spark):
    sets = spark.range(3000).selectExpr("cast(concat('text ', id) as binary) as g", "array(cast(id as int)) as shingles")
    wanted = sets.where("shingles[0] % 7 = 3").select("g")
    kept = {r.shingles[0] for r in similar._marked(sets, wanted).collect()}
    assert {i for i in range(3000) if i % 7 == 3} <= kept and len(kept) < 600


def test_a_worker_takes_few_rows_at_a_time(spark):
    from quillgrid.llm.common import ROWS_TOGETHER, map_batches

    sizes = map_batches(spark.range(5_000).coalesce(1), lambda b: type(b).from_pydict({"n": [b.num_rows]}), "n long").collect()
    assert sum(r.n for r in sizes) == 5_000 and max(r.n for r in sizes) <= ROWS_TOGETHER
