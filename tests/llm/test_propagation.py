import itertools
import random

from pyspark.sql import functions as F

from quillgrid.llm import sharding


def best_gain(wants, room):
    """The largest gain of whole moves that leave no shard with more than its room, by trying all."""
    keys, best = sorted(wants), 0
    for taken in itertools.product(*[range(wants[k][0] + 1) for k in keys]):
        net = list(room)
        for (a, b, _), n in zip(keys, taken):
            net[a] += n
            net[b] -= n
        if min(net) >= 0:
            best = max(best, sum(wants[k][1] * n for k, n in zip(keys, taken)))
    return best


def test_relocation_is_the_best_there_is():
    rng = random.Random(4)
    for _ in range(60):
        shards = rng.choice([2, 3, 4])
        pairs = [(a, b, k) for a in range(shards) for b in range(shards) if a != b for k in (0, 2)]
        wants = {p: (rng.randint(1, 3), rng.choice([1, 2]) * 2.0 ** p[2]) for p in rng.sample(pairs, min(len(pairs), 6))}
        room = [rng.choice([0, 0, 1, 2]) for _ in range(shards)]
        granted = sharding.relocation(wants, room)
        gain, net = 0, list(room)
        for (a, b), n in granted.items():
            net[a] += n
            net[b] -= n
            for _, (held, each) in sorted(((k, v) for k, v in wants.items() if k[:2] == (a, b)), key=lambda x: -x[1][1]):
                gain, n = gain + each * min(n, held), n - min(n, held)
            assert n == 0
        assert min(net) >= 0 and gain == best_gain(wants, room)


def test_full_shards_exchange_rows(spark):
    """4,000 pairs, all divided, no room in any of the eight shards."""
    cells = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cell"), F.lit(1).cast("long").alias("n"))
    quotas = [1000] * 8
    start = sharding.lay_out(cells, quotas, ["g", "cell"])
    assert start.groupBy("g").count().where("count > 1").count() > 3000
    out = sharding.propagate(start, quotas).groupBy("g", "shard").agg(F.sum("n").alias("n")).collect()
    counts = [sum(r.n for r in out if r.shard == s) for s in range(8)]
    assert counts == quotas
    assert len(out) - 4000 <= 80  # divided
