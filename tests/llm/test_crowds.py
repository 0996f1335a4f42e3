"""Crowds of near copies of which many are too far from all others."""

import itertools
import random
import zlib

from test_similar import brute, found, shingles

from quillgrid.llm import similar


def crowd(seed, n, edits):
    """Copies of one text of 150 words with up to `edits` words replaced, and a few of these copies' own copies."""
    rng = random.Random(seed)
    base = [f"a{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        texts.append(words)
    texts += [[*texts[i], "end"] for i in range(0, n, 9)] + [texts[i][:130] for i in range(0, n, 11)]
    return [(i * 7 % 1009, " ".join(words)) for i, words in enumerate(texts)]


def test_a_crowd_takes_few_rounds(spark, monkeypatch):
    rows, searches = crowd(5, 130, 14), []
    components = similar.connected_components

    def counted(*a, **k):
        searches.append(1)
        assert len(searches) <= 4
        return components(*a, **k)

    monkeypatch.setattr(similar, "connected_components", counted)
    expected = brute(rows)
    assert 20 < len({c for _, c in expected}) < 140
    assert found(spark, rows, crowd=4) == expected


def test_a_crowd_makes_few_rows(spark, monkeypatch):
    rows, made = crowd(6, 130, 14), []
    own = {f"{i:04}".encode(): sorted(zlib.crc32(x) >> 1 for x in shingles(t)) for i, t in rows}
    members = spark.createDataFrame([(1, bytearray(g), len(s), bytearray(g)) for g, s in own.items()], "key long, g binary, n int, root binary")
    sets = spark.createDataFrame([(bytearray(g), s) for g, s in own.items()], "g binary, shingles array<int>")
    cut = similar.cut

    def counted(df):
        made.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(similar, "cut", counted)
    linked = {x for r in similar.crowd_links(members, sets, 0.8).collect() for x in (bytes(r.a), bytes(r.b))}
    least = {c for _, c in brute(rows)}
    assert len(own) - len(linked) <= len(least) < len(own) - 20
    assert max(made) <= 4 * len(own)  # of over 12,000 pairs


def test_two_crowds_under_one_key_take_more_pivots(spark):
    rng = random.Random(8)
    texts = [(f"{k}", [f"c{k}-{j}" for j in range(40)]) for k in range(12)]
    sets = [(f"{k}/{i}".encode(), k, sorted({zlib.crc32(w.encode()) >> 1 for w in rng.sample(words, 39)})) for k, words in texts for i in range(10)]
    members = spark.createDataFrame([(1, bytearray(g), len(s), bytearray(g)) for g, _, s in sets], "key long, g binary, n int, root binary")
    own = spark.createDataFrame([(bytearray(g), s) for g, _, s in sets], "g binary, shingles array<int>")
    top = {g: g for g, _, _ in sets}

    def root(g):
        while top[g] != g:
            g = top[g]
        return g

    for r in similar.crowd_links(members, own, 0.8).collect():
        a, b = root(bytes(r.a)), root(bytes(r.b))
        top[max(a, b)] = min(a, b)
    assert len({root(g) for g in top}) == 12
    assert all(root(g).split(b"/")[0] == g.split(b"/")[0] for g in top)


def test_traits_rule_out_no_similar_pair(spark):
    rng = random.Random(2)
    pool = [rng.randrange(-(1 << 31), 1 << 31) for _ in range(60)]
    sets = {}
    for i in range(150):
        own = set(rng.sample(pool, rng.randint(44, 60))) | {rng.randrange(-(1 << 31), 1 << 31) for _ in range(rng.randint(0, 12))}
        sets[f"t{i}".encode()] = sorted(own)
    frame = spark.createDataFrame([(bytearray(g), s) for g, s in sets.items()], "g binary, shingles array<int>")
    n = spark.createDataFrame([(bytearray(g), len(s)) for g, s in sets.items()], "g binary, n int")
    words = ", ".join(f"w{w}" for w in range(similar.WORDS))
    traits = similar._traits(frame, len(sets)).join(n, "g").selectExpr("g", f"struct(n, common, {words}) as t")
    met = traits.selectExpr("g as a", "t as a_t").crossJoin(traits.selectExpr("g as b", "t as b_t")).where("a < b").where(similar._may_fit("a_t", "b_t", 0.8))
    kept = {(bytes(r.a), bytes(r.b)) for r in met.select("a", "b").collect()}
    alike = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(both := {*sets[a]} & {*sets[b]}) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both))}
    assert alike <= kept and 50 < len(alike) and len(kept) < 2 * len(alike)
