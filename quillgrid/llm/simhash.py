"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints within `distance` bits are found exactly. The 64 bits are grouped into partitions, correlated
bits together; a partition i gets a threshold t_i of its own, with sum(t_i + 1) = distance + 1, so that any
two fingerprints within the distance are within t_i in some partition (t_i = -1: never probed). Partitions
and thresholds are those of the least estimated cost: pairs that a threshold lets through plus keys that it
makes, from the bits' joint counts over all fingerprints, allocated by dynamic programming. Fingerprints
then meet under their partition's bits (probes also under those with up to t_i of them flipped) and are
verified.

A crowded key, under which more than `crowd` fingerprints meet, emits no pairs. Its fingerprints meet again
under every value within one bit of theirs: two within distance 2 share such a value, and all under one
value are within distance 2 of each other, so a star to the smallest one holds every link that components
need with at most 65 rows per fingerprint. For distance 1 the flipped values are looked up themselves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import cut, map_batches, spread_join, utf8
from quillgrid.llm.components import connected_components

BITS = 64
DISTANCE, SHINGLE, SEED = 2, 3, 42
#: Fingerprints under one key from which the exact way for crowded keys is taken.
CROWD = 64
#: Bytes of a document that are split into words at a time.
PIECE = 1 << 20
#: Cost of a key against that of a candidate pair.
KEY_COST = 1.0


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Word lists of a text, each of about PIECE bytes; b"".split() parts at exactly the contract's spaces."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].lower().split()
        at = end


def _hash_pieces(data: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of a text's word shingles, in arrays of about PIECE bytes of text; of all its words, if fewer."""
    carry, some = [], False
    digest = xxhash.xxh64_intdigest
    for words in _pieces(data):
        words = carry + words
        if len(words) >= shingle:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            stops = ends[shingle - 1 :].tolist()
            begins = [0, *(ends[: len(words) - shingle] + 1).tolist()]
            yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, stops)), np.uint64, len(stops))
            carry = words[len(words) - shingle + 1 :]
        else:
            carry = words
    if not some and carry:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits, total = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 255):  # what a byte can count
        total += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return total


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, as an unsigned 64-bit integer; 0 without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _hash_pieces(data, shingle, seed):
        ones += _ones(hashes)
        n += len(hashes)
    return _majority(ones, n)


def shingle_hashes(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> tuple[int, np.ndarray]:
    """fingerprint() and the hashes that it is made from."""
    pieces = list(_hash_pieces(data, shingle, seed))
    hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
    return _majority(_ones(hashes), len(hashes)), hashes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long; null and empty texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle, seed) if t else 0 for t in utf8(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set, over all of them."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            own = np.asarray(batch.column(0)).astype(np.int64).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(own), 1 << 16):
                bits = np.unpackbits(own[at : at + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def _agreement(both: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Chances that two fingerprints agree in a bit, and in each two bits."""
    p11 = both / n
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return p**2 + (1 - p) ** 2, p11**2 + p10**2 + p01**2 + p00**2


def _grouped(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of about equal width: each grows by the bit most correlated with it."""
    left, out = set(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, out))) // (m - i)
        own = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < width:
            own.append(best := max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.discard(best)
        out.append(sorted(own))
    return out


def _within(bits: list[int], one: np.ndarray, two: np.ndarray, most: int) -> list[float]:
    """Chances that two fingerprints differ in at most 0, 1 .. `most` of the bits.

    Each bit depends on the earlier one that it is most correlated with.
    """
    lift = two / np.outer(one, one)
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for i, b in enumerate(bits):
        up = max((lift[b, a] for a in bits[:i]), default=1.0)
        same = min(0.999999, one[b] * max(1.0, up))
        moved = chance * same
        moved[1:] += chance[:-1] * (1 - same)
        chance = moved
    return np.cumsum(chance).tolist()


def plan(both: np.ndarray, n: int, distance: int = DISTANCE, most_parts: int = 5) -> list[tuple[list[int], int]]:
    """The partitions to probe and their thresholds, of the least estimated cost."""
    one, two = _agreement(both, max(n, 1))
    corr = np.abs(two - np.outer(one, one)) / np.sqrt(np.outer(one * (1 - one) + 1e-9, one * (1 - one) + 1e-9))
    np.fill_diagonal(corr, 0)
    best, chosen = None, []
    for m in range(1, most_parts + 1):
        groups = _grouped(corr, m)
        #: cost[i][k]: of threshold k - 1 in partition i
        cost = []
        for bits in groups:
            near = _within(bits, one, two, distance)
            keys = list(itertools.accumulate(math.comb(len(bits), k) for k in range(distance + 1)))
            cost.append([0.0] + [near[k] * n * n / 2 + KEY_COST * n * (1 + (keys[k] if k else 0)) for k in range(distance + 1)])
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (paid, ks) in table.items():
                for k, extra in enumerate(c[: distance + 2 - used]):
                    new = (paid + extra, (*ks, k))
                    if used + k not in grown or new < grown[used + k]:
                        grown[used + k] = new
            table = grown
        paid, ks = table[distance + 1]
        if best is None or paid < best:
            best, chosen = paid, [(bits, k - 1) for bits, k in zip(groups, ks) if k]
    return chosen


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(fp, part, key, probe): what each fingerprint is filed under, and what it is looked up under."""
    entries = []
    for i, (bits, t) in enumerate(parts):
        mask = _signed(sum(1 << b for b in bits))
        entries.append((i, mask, 0, False))
        if t > 0:
            for k in range(t + 1):
                entries += [(i, mask, _signed(sum(1 << b for b in some)), True) for some in itertools.combinations(bits, k)]
    spec = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(mask).cast("long").alias("mask"), F.lit(flip).cast("long").alias("flip"), F.lit(p).alias("probe")) for i, mask, flip, p in entries]) if len(entries) <= 8 else None
    if spec is None:
        spark = fps.sparkSession
        small = spark.createDataFrame([(entries,)], "e array<struct<part: int, mask: long, flip: long, probe: boolean>>")
        fps = fps.crossJoin(F.broadcast(small))  # one row
        spec = F.col("e")
    return fps.select("fp", F.explode(spec).alias("s")).select("fp", "s.part", F.col("fp").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip")).alias("key"), "s.probe")


def _near_one(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within distance 2 of each other."""
    flips = [0, *(_signed(1 << b) for b in range(BITS))]
    met = fps.select("fp", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("value"))
    stars = met.groupBy("value").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    return stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between different fingerprints of `fps` (distinct, column fp) within `distance`.

    Every pair within the distance is linked, directly or through others that are within it.
    """
    if distance not in (1, 2):
        raise ValueError("crowded keys are settled exactly for distances 1 and 2 only")
    n = fps.count()
    parts = plan(bit_counts(fps), n, distance)
    keys = cut(_keys(fps, parts))
    self_met = all(t <= 0 for _, t in parts)
    counts = keys.groupBy("part", "key").agg(F.count_if(~F.col("probe")).alias("filed"), F.count_if("probe").alias("asked"))
    looked = [i for i, (_, t) in enumerate(parts) if t > 0]
    pairs_of = F.when(F.col("part").isin(looked), F.col("asked") * F.col("filed")).otherwise(F.col("filed") * F.col("filed")) if not self_met else F.col("filed") * F.col("filed")
    met = F.when(F.col("part").isin(looked), (F.col("filed") > 0) & (F.col("asked") > 1)).otherwise(F.col("filed") > 1) if not self_met else F.col("filed") > 1
    shared = cut(counts.where(met).select("part", "key", (pairs_of > crowd * crowd).alias("crowded")))
    held = cut(keys.join(shared, ["part", "key"]))
    plain = held.where("not crowded").drop("crowded")
    filed = plain.where("not probe").select("part", "key", F.col("fp").alias("a"))
    asked = plain.where(F.col("probe") | ~F.col("part").isin(looked)).select("part", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    found = filed.join(asked, ["part", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    crowded = held.where("crowded").select("fp").distinct()
    return found.unionByName(_near_one(crowded) if distance == 2 else _near_value(crowded))


def _near_value(fps: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints that differ in one bit: one is a value of the other's flips."""
    flips = F.array(*[F.lit(_signed(1 << b)).cast("long") for b in range(BITS)])
    values = fps.select(F.col("fp").alias("a"), F.explode(flips).alias("f")).select("a", F.col("a").bitwiseXOR(F.col("f")).alias("b"))
    return values.where("a < b").join(fps.select(F.col("fp").alias("b")), "b").select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    shingle: int = SHINGLE,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are `shingle` words
    joined by spaces (all words, if fewer). A bit is set if over half of the shingles' XXH64 (seed 42) have
    it. Fingerprints within `distance` bits are linked; component_id is the smallest id that can be reached.
    Null texts and texts without words have fingerprint 0 and are linked like any other. Repeated rows give
    repeated rows; a null id takes part with its text, and component_id is null only where all ids of a
    component are. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    least = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("held")))
    roots = connected_components(links(least.select("fp"), distance, crowd))
    joined = cut(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    firsts = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("held"))
    of = spread_join(joined.select("fp", "root", F.col("held").alias("copies")), firsts, "root")
    out = spread_join(rows, of.select("fp", "component_id", F.col("copies").alias("held")), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
