"""SimHash near-duplicates at a given similarity of their shingle sets.

Sixty-four bits can't tell a similarity of 0.8 from less, and a bit distance wide enough for it (11 and more) can only
be searched by comparing nearly all fingerprints with each other. So fingerprints that the generalised pigeonhole finds
close are candidates here, and so are texts that share a band of shingle minima; every candidate is verified by the
exact Jaccard similarity of its distinct shingles, kept as 32-bit hashes. A pair at the similarity shares none of `bands`
bands of `rows` minima with a chance of (1 - similarity ** rows) ** bands: 0.00007 at 0.8, and ever less above.

Equal texts are one text before anything is paired. Under a key that more than `crowd` texts share, pivots are those
with the least share of shingles that no other text of a crowd has, one in the first round and twice as many in each
further one, and every text is compared with them; pairs are made only of texts whose components still differ. Two
texts are compared only if their sizes, their shared shingles and these shingles' parities allow the similarity. So a
crowd of near copies costs a few comparisons a text, and no pair of a shared key is left out that could be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import cut, packed, sliced, spread_join, swept, utf8, written
from quillgrid.llm.components import connected_components
from quillgrid.llm.simhash import SEED, links, shingle_hashes

SHINGLE, SIMILARITY, BANDS, ROWS, DISTANCE, CROWD = 5, 0.8, 24, 5, 2, 16
#: Texts that a task remembers, so as to give the shingles of equal ones once.
REMEMBERED = 200_000
#: Roots whose new names are broadcast at most; beyond that they are joined by shuffling.
MOST_KEYS = 1 << 16
#: Bits that stand for the texts of candidates, broadcast as words of 64.
MARKS = 1 << 24
#: Shingles whose minima are taken at a time.
PIECE = 1 << 10
#: Words of 64 bits that hold the parities of a text's shared shingles.
WORDS = 8


def _permutations(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minima(hashes: np.ndarray, bands: int, rows: int, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    """One key for each band: a digest of `rows` minima of the 32-bit hashes under permutations of the band's own."""
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), PIECE):
        own = hashes[None, at : at + PIECE] * factors[:, None]
        own += shifts[:, None]
        np.minimum(least, own.min(axis=1), out=least)
    cells = least.reshape(bands, rows)
    return [xxhash.xxh64_intdigest(cells[b].tobytes(), b) for b in range(bands)]


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, g, fp, n, keys, shingles): g is a digest of the text's words, fp its SimHash, n its distinct shingles.

    keys are those of the bands and one of the fingerprint; they and the sorted shingle hashes are given once in a
    task for equal texts, and are null where they were given before.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    factors, shifts = _permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(5)]
            for data in utf8(batch.column(1)):
                g = xxhash.xxh3_128_digest(b" ".join((data or b"").lower().split()))
                keys = held = None
                if g not in seen:
                    fp, hashes = shingle_hashes(data or b"", shingle)
                    held = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
                    keys = np.array([*minima(held, bands, rows, factors, shifts), xxhash.xxh64_intdigest(fp.to_bytes(8, "little"), bands)], np.uint64).view(np.int64)
                    held = held.view(np.int32)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[g] = (int(np.uint64(fp).view(np.int64)), len(held))
                fp, n = seen[g]
                for column, value in zip(out, (g, fp, n, keys, held)):
                    column.append(value)
            if out[0]:
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["id", "g", "fp", "n", "keys", "shingles"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, g binary, fp long, n int, keys array<long>, shingles array<int>")


def _sizes_fit(a: Column, b: Column, similarity: float) -> Column:
    """Sizes that allow the similarity; two texts without words are alike."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def _marked(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `sets` whose g is in `wanted`, and a few others: a filter of bits, whatever the number of texts."""
    at = F.pmod(F.xxhash64("g"), F.lit(MARKS))
    word, bit = F.floor(at / 64), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(g), {MARKS}) % 64 as int))")
    words = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("marks"))
    met = sets.withColumn("word", word).join(F.broadcast(words), "word").where(F.col("marks").bitwiseAND(bit) != 0)
    return met.select(*sets.columns)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), repeats removed, whose sets (g, shingles) have at least the Jaccard similarity."""
    pairs = cut(pairs.select("a", "b").distinct())
    most = pairs.count()
    wanted = cut(packed(pairs.select(F.col("a").alias("g")).unionByName(pairs.select(F.col("b").alias("g"))).distinct(), 2 * most))
    return _alike(packed(pairs, most), _marked(sets, wanted).dropDuplicates(["g"]), similarity, most)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """The pairs (a, b), `most` of them, whose sets (g, shingles), one for each g, have the similarity."""
    held = packed(pairs.join(sets.select(F.col("g").alias("a"), F.col("shingles").alias("x")), "a"), most)
    held = held.join(sets.select(F.col("g").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    return cut(packed(held.where((either == 0) | (both >= F.lit(similarity) * either)).select("a", "b"), most))


def _traits(sets: DataFrame, most: int) -> DataFrame:
    """(g, common, w0, w1, ..) of sets (g, shingles), `most` of them: how many shingles of each are in others too, and
    the parities of their numbers under 64 * WORDS bits."""
    every = sets.select("g", F.explode("shingles").alias("s"))
    lone = every.groupBy("s").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("n")).where("n = 1")
    marks = every.withColumn("sign", F.lit(1)).unionByName(lone.select("g", "s", F.lit(-1).alias("sign")))
    bit = F.expr("shiftleft(1L, s & 63)")
    words = [F.bit_xor(F.when(F.expr(f"(s >> 6) & {WORDS - 1}") == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    return packed(marks.groupBy("g").agg(F.sum("sign").alias("common"), *words), most)


def _may_fit(a: str, b: str, similarity: float) -> Column:
    """Whether two texts of traits `a` and `b`, structs (n, common, w0, ..), can have the similarity.

    Shingles that no other text has are in no intersection; of the others, at least as many are in one text only as
    parities differ.
    """
    odd = sum((F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}"))) for w in range(WORDS)), F.lit(0))
    fewer = F.least(f"{a}.common", f"{b}.common")
    both = F.least(fewer, F.floor((F.col(f"{a}.common") + F.col(f"{b}.common") - odd) / 2))
    return _enough(fewer, F.col(f"{a}.n"), F.col(f"{b}.n"), similarity) & _enough(both, F.col(f"{a}.n"), F.col(f"{b}.n"), similarity)


def _pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs under each key of members (key, g, n)."""
    left = members.select("key", F.col("g").alias("a"), F.col("n").alias("a_n"))
    right = members.select("key", F.col("g").alias("b"), F.col("n").alias("b_n"))
    return left.join(right, "key").where((F.col("a") < F.col("b")) & _sizes_fit(F.col("a_n"), F.col("b_n"), similarity)).select("a", "b")


def _enough(both: Column, a_n: Column, b_n: Column, similarity: float) -> Column:
    return both >= F.lit(similarity) * (a_n + b_n - both)


def _pairs_apart(state: DataFrame, similarity: float) -> DataFrame:
    """Pairs under each key of state (key, g, root, main, t) that are of different roots and may be similar, one of them
    at least not of the key's `main` root; texts that fit no size of their key are left out before they are paired."""
    sizes = state.groupBy("key", F.col("t.n").alias("size")).agg(F.max("t.common").alias("top"))
    apart = state.where("root <> main").select("key", F.col("g").alias("a"), F.col("root").alias("a_root"), F.col("t").alias("a_t"))
    fits = _enough(F.col("a_t.common"), F.col("a_t.n"), F.col("size"), similarity) & _enough(F.col("top"), F.col("a_t.n"), F.col("size"), similarity)
    left = apart.join(sizes.withColumnRenamed("key", "its"), (F.col("key") == F.col("its")) & fits, "left_semi")
    right = state.select("key", F.col("g").alias("b"), F.col("root").alias("b_root"), F.col("t").alias("b_t"), (F.col("root") == F.col("main")).alias("inside"))
    met = left.join(right, "key").where((F.col("a_root") != F.col("b_root")) & (F.col("inside") | (F.col("a") < F.col("b"))) & _may_fit("a_t", "b_t", similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _open(state: DataFrame, most: int | None = None) -> DataFrame:
    """`state` (key, g, root, ..) of `most` rows at most without the keys that hold one root only; `main`: the root that
    most of a key's rows have."""
    state = cut(packed(state.drop("main"), most))
    parts = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("held"), F.max(F.struct("n", "root")).alias("m"))
    return cut(packed(spread_join(state, several.where("roots > 1").select("key", "held", F.col("m.root").alias("main")), "key", most=most), most))


def _renamed(state: DataFrame, above: DataFrame) -> DataFrame:
    """`state` (.., root) with the roots that `above` (node, root) leads to."""
    found = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    few = found.count() <= MOST_KEYS
    return state.join(F.broadcast(found) if few else found, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def _pivots(state: DataFrame, turn: int) -> DataFrame:
    """(key, pivots, held): of each key of state (key, g, root, t), the text with the least share of lone shingles in each
    of 2 ** turn cells that its roots are dealt to."""
    lone = 1 - F.col("t.common") / F.greatest("t.n", F.lit(1))
    place = F.struct(lone.alias("lone"), F.col("g").alias("pivot"), F.col("root").alias("pivot_root"), F.col("t").alias("pivot_t"))
    cells = state.groupBy("key", F.pmod(F.xxhash64("root", F.lit(turn)), F.lit(1 << turn)).alias("cell")).agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("held"))
    return cells.groupBy("key").agg(F.collect_list("p").alias("pivots"), F.sum("held").alias("held"))


def _root_links(pairs: DataFrame, state: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links (a, b) between the roots in `state` of the texts of those `pairs` that are similar."""
    more = _alike(cut(packed(pairs.distinct(), most)), sets, similarity, most)
    roots = cut(packed(state.select("g", "root").distinct(), most))
    joined = more.join(roots.select(F.col("g").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("g").alias("b"), F.col("root").alias("y")), "b")
    return cut(packed(joined.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), most))


def crowd_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links (a, b) among the roots of members (key, g, n, root) of crowded keys, that connect those of all similar
    texts of a key; None if there are none.

    Rounds end when the pairs that are left, of different roots under one key and not ruled out by their traits, are no
    more than the members times the pivots of a key.
    """
    members = cut(members)
    most = members.count()
    members = _open(members, most)
    if members.isEmpty():
        return None
    texts = cut(packed(members.select("g").distinct(), most))
    own = cut(packed(_marked(sets, texts).join(texts, "g", "left_semi").dropDuplicates(["g"]), most))
    zero = F.lit(0).cast("long")
    traits = F.struct("n", *[F.coalesce(c, zero).alias(c) for c in ("common", *(f"w{w}" for w in range(WORDS)))]).alias("t")
    state = members.join(_traits(own, texts.count()), "g", "left").select("key", "g", "root", traits)
    # a text that shares too little with all others together is similar to none
    state = _open(state.where(F.col("t.common") >= F.lit(similarity) * F.col("t.n")), most)
    found, turn, left = None, 0, most
    while left and not state.isEmpty():
        met = spread_join(state, _pivots(state, turn), "key", most=most).withColumn("p", F.explode("pivots"))
        met = met.select("g", "root", "t", "p.pivot", "p.pivot_root", "p.pivot_t").where((F.col("root") != F.col("pivot_root")) & _may_fit("t", "pivot_t", similarity))
        own_links = _root_links(met.select(F.least("g", "pivot").alias("a"), F.greatest("g", "pivot").alias("b")), state, own, similarity, most << turn)
        many = own_links.count()
        if many:
            found = own_links if found is None else found.unionByName(own_links)
            state = _open(_renamed(state, connected_components(own_links, most=many)), most)
        apart = _pairs_apart(state, similarity)
        left = apart.count()
        if 0 < left <= most << turn:
            own_links = _root_links(apart, state, own, similarity, left)
            return own_links if found is None else found.unionByName(own_links)
        turn += 1
        met = own_links = apart = None
        swept(sets.sparkSession)
    return found


def similar_roots(sketch: DataFrame, similarity: float = SIMILARITY, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(g, root) of all texts of sketches(): one root for all that candidates of at least the similarity connect."""
    sets = sketch.where("shingles is not null").select("g", "shingles")
    texts = sketch.where("keys is not null")
    keys = written(texts.select("g", "n", F.explode("keys").alias("key")).distinct())
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    # a text has 25 keys and is once under each, so no key holds more than a 25th of the rows; Spark splits skewed joins
    members = cut(keys.join(shared.select("key", (F.col("held") > crowd).alias("crowded")), "key"))
    firsts = cut(texts.groupBy("fp").agg(F.min("g").alias("g")))
    near = links(firsts.select("fp"), distance)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("g").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("g").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    alike = verified(near.unionByName(_pairs(members.where("not crowded"), similarity)), sets, similarity)
    found = connected_components(alike, most=alike.count())
    swept(sketch.sparkSession)
    every = keys.select("g").distinct().join(found.withColumnRenamed("node", "g"), "g", "left").select("g", F.coalesce("root", "g").alias("root"))
    every = cut(every)
    more = crowd_links(members.where("crowded").select("key", "g", "n").join(every, "g"), sets, similarity)
    return every if more is None else cut(_renamed(every, connected_components(more, most=more.count())))


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    distance: int = DISTANCE,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits, of `shingle` words), component_id.

    Words are those of simhash.near_duplicates(). Two texts are linked if the sets of their shingles have a Jaccard
    similarity of at least `similarity`; a text of fewer words than a shingle is one shingle, and null texts and texts
    without words are alike. component_id is the smallest id that links lead to, directly or not, null only where all
    ids of a component are. Repeated rows give repeated rows; other columns are ignored; an empty table gives an
    empty result.
    """
    sketch = written(sketches(docs, id_col, text_col, shingle, bands, rows))
    least = cut(sketch.groupBy("g").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    joined = cut(least.join(similar_roots(sketch, similarity, distance, crowd), "g"))
    firsts = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("held"))
    of = spread_join(joined.select("g", "root", "copies"), firsts, "root").select("g", "component_id", F.col("copies").alias("held"))
    out = spread_join(sketch.select("id", "g", "fp"), of, "g")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
