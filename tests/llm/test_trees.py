import random

from quillgrid.llm import chat


def slow_paths(data, top):
    out = {}
    for conv in {r[0] for r in data}:
        own = {node: (parent, score or 0.0) for c, node, parent, score in data if c == conv}
        parents = {p for p, _ in own.values()}
        found = []
        for leaf in own.keys() - parents:
            line, at = [], leaf
            while at in own and at not in line:
                line.append(at)
                at = own[at][0]
            if at is None:
                found.append((-round(sum(own[x][1] for x in line) / len(line), 9), leaf, line[::-1]))
        for path, (_, _, line) in enumerate(sorted(found)[:top]):
            out |= {(conv, path, pos): node for pos, node in enumerate(line)}
    return out


def found(spark, data, top):
    nodes = spark.createDataFrame(data, "conv long, node long, parent long, score double")
    rows = chat.paths(nodes, top).collect()
    out = {(r.conv, r.path, r.pos): r.node for r in rows}
    assert len(out) == len(rows)
    return out


def test_a_line_into_a_circle_ends(spark):
    data = [(1, 3, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 1, 1.0)]
    assert found(spark, data, 1) == {}
    assert found(spark, [*data, (1, 9, None, 0.0), (1, 8, 9, 0.5)], 1) == {(1, 0, 0): 9, (1, 0, 1): 8}


def test_random_trees(spark):
    rng = random.Random(5)
    data = []
    for conv in range(12):
        n = rng.choice([1, 2, 7, 40])
        for node in range(n):
            parent = None if node == 0 or rng.random() < 0.05 else rng.randrange(n if rng.random() < 0.06 else node)
            data.append((conv, node, 500 if rng.random() < 0.02 else parent, rng.choice([None, 0.25, 0.5, 2.0])))
    rng.shuffle(data)
    for top in (1, 3):
        assert found(spark, data, top) == slow_paths(data, top)


def test_deep_and_bushy_trees(spark):
    chain = [(1, i, i - 1 if i else None, 1.0) for i in range(300)]
    bush = [(2, 0, None, 0.0), *((2, i, (i - 1) // 2, i % 7 / 8) for i in range(1, 2000))]
    star = [(3, 0, None, 0.0), *((3, i, 0, (i * 37 % 101) / 128) for i in range(1, 3000))]
    data = chain + bush + star
    out = found(spark, data, 2)
    assert out == slow_paths(data, 2)
    assert len(out) < 350
