"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. The linked rows start dealt evenly over the shards by a hash of text and id, so that
copies lie apart; only a text with more rows than a shard's quota, which can't be whole, starts in whole shards. In each
round the rows of a text see how many of its rows every shard holds, and want to move to the shard that holds the most.
What may move between any two shards, those of the greatest gain first, is the solution of a linear program: the largest
gain by which no shard holds more than its quota, so full shards exchange rows. Rounds go on until nothing is granted;
each brings a text's rows closer together, so they end. Rows of one text in one shard are alike, so the state is one row
for each text and shard, and the program sees one number for each two shards and power of two of the gain.
What exchanges can't unite, as numbers don't fit, is laid end to end over what the whole texts leave of the quotas, if
that divides fewer. Unlinked documents have no neighbours and fill what is left; they cut nothing. Quotas differ by one
row at most, and all are filled. At most shards - 1 borders cut a text, whatever the input's size.

A copy's place follows from its rank among its text's copies, counted in salted cells so that a text with a
large share of all rows is ranked by many tasks.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.common import buckets_for, cut, running_total

SHARDS, SEED = 24, 42
#: Cells of a text for each shard, at least; there are more where the rows are many.
CELLS_PER_SHARD = 4


def _between(begin: Column, end: Column, ranges: list[tuple[int, int, int]]) -> Column:
    """The parts of [begin, end) in each of the ranges (from, to, shard): array of (shard, n)."""
    held = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(s).alias("s")) for a, b, s in ranges])
    met = F.filter(held, lambda r: (r.a < end) & (r.b > begin))
    return F.transform(met, lambda r: F.struct(r.s.alias("shard"), (F.least(r.b, end) - F.greatest(r.a, begin)).alias("n")))


def _held(state: DataFrame, shards: int) -> list[int]:
    """Rows of each shard; `shards` numbers at most reach the driver."""
    found = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _numbers(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard.cast("int") + 1)


def _even(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _ranges(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Stretches (from, to, shard) of these sizes, end to end; empty ones are left out."""
    ends = list(itertools.accumulate(sizes))
    return [(end - n, end, s) for s, (n, end) in enumerate(zip(sizes, ends)) if n]


def lay_out(units: DataFrame, sizes: list[int], order: list[str]) -> DataFrame:
    """(g, shard, n) of units (g, n, ..), laid end to end in the order of a hash of `order`, their key, over stretches of `sizes`."""
    total = sum(sizes)
    if not total:
        return units.select("g", F.lit(0).alias("shard"), "n").where("n is null")
    bucket = F.pmod(F.xxhash64(*order, F.lit(SEED)), F.lit(buckets_for(total)))
    placed = running_total(units.select("n", F.lit(0).alias("all"), bucket.alias("bucket"), *order), ["all"], "bucket", [F.col(c) for c in order], F.col("n"), "before")
    parts = placed.select("g", F.inline(_between(F.col("before"), F.col("before") + F.col("n"), _ranges(sizes))))
    return parts.groupBy("g", "shard").agg(F.sum("n").alias("n"))


def relocation(wants: dict[tuple[int, int, int], tuple[int, float]], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows move from one shard to another, for the largest gain that leaves no shard with more than its room.

    wants: rows and gain of each (from, to, level), gains above 0. What leaves a shard makes room in it. The linear
    program of the method, solved as a flow of least cost: all moves are granted, and what then overflows a shard is
    pushed back along the cheapest paths of moves that are refused, or granted again.
    """
    levels: dict[tuple[int, int], list[list]] = {}
    for (a, b, _), (n, gain) in sorted(wants.items()):
        levels.setdefault((a, b), []).append([gain, n, n])  # gain, rows, granted
    over = [-r for r in room]
    for (a, b), held in levels.items():
        held.sort(key=lambda x: -x[0])
        n = sum(x[1] for x in held)
        over[a] -= n
        over[b] += n
    while any(x > 0 for x in over):
        cost = [0.0 if x > 0 else math.inf for x in over]
        via: list = [None] * len(over)
        for _ in over:
            changed = False
            for (a, b), held in levels.items():
                last = next((x for x in reversed(held) if x[2]), None)
                if last and cost[b] + last[0] < cost[a] - 1e-9:
                    cost[a], via[a], changed = cost[b] + last[0], (b, last, -1), True
                first = next((x for x in held if x[2] < x[1]), None)
                if first and cost[a] - first[0] < cost[b] - 1e-9:
                    cost[b], via[b], changed = cost[a] - first[0], (a, first, 1), True
            if not changed:
                break
        end = min((s for s, x in enumerate(over) if x < 0 and cost[s] < math.inf), key=lambda s: (cost[s], s))
        path, at = [], end
        while via[at]:
            path.append(via[at])
            at = via[at][0]
        n = min(over[at], -over[end], *(x[2] if sign < 0 else x[1] - x[2] for _, x, sign in path))
        for _, x, sign in path:
            x[2] += sign * n
        over[at] -= n
        over[end] += n
    granted = {pair: sum(x[2] for x in held) for pair, held in levels.items()}
    return {pair: n for pair, n in granted.items() if n}


def propagate(state: DataFrame, quotas: list[int], rounds: int | None = None, seed: int = SEED) -> DataFrame:
    """Balanced label propagation over (g, shard, n): n linked rows of text g in a shard, within the quotas.

    In a round the rows of a text see how many of its rows each shard holds, and all want to move to the shard that
    holds the most; equal numbers are told apart anew in each round. Between any two shards those of the greatest gain
    move, as many as relocation() grants. Stops when nothing is granted any more, or after `rounds` rounds if given; any
    round's state is valid. A move goes to a part that is no smaller and stays, so the parts' squares grow with every
    round and the rounds end.
    """
    shards = len(quotas)
    state = cut(state)
    for turn in itertools.count() if rounds is None else range(rounds):
        room = [q - n for q, n in zip(quotas, _held(state, shards))]
        buckets = buckets_for(sum(quotas))
        whole = Window.partitionBy("g")  # `shards` rows at most
        own = F.struct("n", F.xxhash64("g", "shard", F.lit(seed + turn)).alias("tie"), "shard")
        seen = state.withColumn("best", F.max(own).over(whole)).where("best.shard <> shard")
        gain = F.col("best.n") - F.col("n") + 1  # rows that one is with more, after the move
        wants = seen.select("g", "shard", "n", F.col("best.shard").alias("to"), gain.alias("gain"))
        wants = wants.withColumn("level", F.floor(F.log2("gain")).cast("int"))
        wants = cut(wants.withColumn("bucket", (63 - F.col("level")) * buckets + F.pmod(F.xxhash64("g", F.lit(seed)), F.lit(buckets))))
        asked = wants.groupBy("shard", "to", "level").agg(F.sum("n").alias("n"), F.sum(F.col("gain").cast("double") * F.col("n")).alias("gain")).collect()
        granted = relocation({(r.shard, r.to, r.level): (r.n, r.gain / r.n) for r in asked}, room)
        if not granted:
            break
        grants = F.from_json(F.lit(json.dumps([{"shard": a, "to": b, "most": n} for (a, b), n in granted.items()])), "array<struct<shard: int, to: int, most: long>>")
        most = state.sparkSession.range(1).select(F.inline(grants))
        queued = running_total(wants, ["shard", "to"], "bucket", [F.col("g")], F.col("n"), "before").join(F.broadcast(most), ["shard", "to"])
        moves = queued.withColumn("taken", F.least(F.col("n"), F.col("most") - F.col("before"))).where("taken > 0")
        sides = F.array(F.struct(F.col("shard").alias("shard"), (-F.col("taken")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("taken").alias("n")))
        changes = moves.select("g", F.inline(sides))
        state = cut(state.select("g", "shard", "n").unionByName(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return state


def _mended(state: DataFrame, quotas: list[int]) -> DataFrame:
    """`state` with the texts that propagation left divided laid end to end over what the whole ones leave of the
    quotas, if that divides fewer; what no exchange of equal numbers can unite."""
    state = cut(state.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("g"))).select("g", "shard", "n", "parts"))
    texts = state.where("parts > 1").groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    sums = texts.agg(F.sum("n").alias("n"), F.sum(F.col("parts") - 1).alias("cuts")).first()
    if not sums.n:
        return state.drop("parts")
    whole = state.where("parts = 1").drop("parts")
    room, left = [q - n for q, n in zip(quotas, _held(whole, len(quotas)))], sums.n
    for s, r in enumerate(room):
        room[s] = min(r, left)
        left -= room[s]
    laid = cut(lay_out(texts.select("g", "n"), room, ["g"]))
    fewer = laid.count() - laid.select("g").distinct().count() < sums.cuts
    return whole.unionByName(laid) if fewer else state.drop("parts")


def _shares(rows: int, room: list[int]) -> list[int]:
    """`rows` dealt over rooms in proportion."""
    total = max(1, sum(room))
    ends = [rows * x // total for x in itertools.accumulate(room)]
    return [b - a for a, b in zip([0, *ends], ends)]


def placed_texts(cells: DataFrame, quotas: list[int], rounds: int | None = None, seed: int = SEED) -> DataFrame:
    """(g, shard, n) of the linked texts of cells (g, cell, n): a balanced start by hash, propagation, mending.

    A text with more rows than a shard's quota can't be whole: it starts in whole shards, one after the other.
    """
    sums = cut(cells.withColumn("all", F.sum("n").over(Window.partitionBy("g"))).where("all > 1"))
    huge, most = sums.where(F.col("all") > max(quotas)), max(quotas)
    texts = huge.groupBy("g").agg(F.sum("n").alias("n"))
    taken = texts.agg(F.sum("n")).first()[0] or 0
    sizes, left = [], taken
    for q in quotas:
        sizes.append(min(q, left))
        left -= sizes[-1]
    held = cut(lay_out(texts, sizes, ["g"]))
    rest = [q - n for q, n in zip(quotas, sizes)]
    linked = sums.where(F.col("all") <= most)
    rows = linked.agg(F.sum("n")).first()[0] or 0
    start = lay_out(linked.select("g", "cell", "n"), _shares(rows, rest), ["g", "cell"])
    return held.unionByName(_mended(propagate(start, rest, rounds, seed), rest))


def _settle(state: DataFrame, single: DataFrame, quotas: list[int]) -> DataFrame:
    """(g, shard, n) of all rows with every quota exactly filled.

    What a shard holds beyond its quota leaves it, and joins the unlinked rows in the shards with room.
    """
    held = _held(state, len(quotas))
    excess = [max(0, n - q) for q, n in zip(quotas, held)]
    loose = single
    buckets = buckets_for(sum(quotas))
    bucket = F.pmod(F.xxhash64("g"), F.lit(buckets))
    if any(excess):
        queued = cut(running_total(state.withColumn("bucket", bucket), ["shard"], "bucket", [F.col("g")], F.col("n"), "before"))
        out = F.greatest(F.lit(0), F.least(F.col("n"), _numbers(excess, F.col("shard")) - F.col("before")))
        queued = queued.withColumn("out", out)
        loose = loose.unionByName(queued.where("out > 0").select("g", F.col("out").alias("n")))
        state = queued.where("n > out").select("g", "shard", (F.col("n") - F.col("out")).alias("n"))
    ranges, at = [], 0
    for s, (q, n) in enumerate(zip(quotas, held)):
        if q > n:
            ranges.append((at, at + q - n, s))
            at += q - n
    if not ranges:
        return state.select("g", "shard", "n")
    loose = cut(loose.withColumn("all", F.lit(0)).withColumn("bucket", bucket))
    placed = running_total(loose, ["all"], "bucket", [F.col("g")], F.col("n"), "before")
    parts = placed.select("g", F.inline(_between(F.col("before"), F.col("before") + F.col("n"), ranges)))
    return state.select("g", "shard", "n").unionByName(parts).groupBy("g", "shard").agg(F.sum("n").alias("n"))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: counts of shards are at most one apart. size is the text's UTF-8 bytes plus 8; null
    counts as empty, also for text_crc32 and as a text to be linked by. slot numbers a shard's rows from 0
    without gaps, copies side by side; grown_shard is null. Null ids are allowed, repeated rows are rows of
    their own, other columns are ignored, and an empty table gives an empty result. Reruns agree, up to
    which of several identical rows gets which of their places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("g"),  # texts that collide would be kept together, no more
        )
    )
    cells_a_text = max(shards * CELLS_PER_SHARD, buckets_for(rows.count()))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cells_a_text)))
    cells = cut(rows.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    quotas = _even(total, shards)
    texts = cut(cells.groupBy("g").agg(F.sum("n").alias("n")))
    linked = placed_texts(cells, quotas, rounds, seed)
    places = cut(_settle(linked, texts.where("n = 1"), quotas))
    places = places.withColumn("bucket", F.pmod(F.xxhash64("g", F.lit(seed)), F.lit(buckets_for(total, 5_000, 64))))
    places = cut(running_total(places, ["shard"], "bucket", [F.col("g")], F.col("n"), "base"))
    along = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = places.withColumn("a", F.coalesce(F.sum("n").over(along), F.lit(0)))
    spans = spans.groupBy("g").agg(F.collect_list(F.struct("a", (F.col("a") + F.col("n")).alias("b"), "shard", "base")).alias("spans"))  # `shards` at most
    before = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = first.join(spans, "g").select(
        "g", "cell", "first", F.filter("spans", lambda s: (s.a < F.col("first") + F.col("n")) & (s.b > F.col("first"))).alias("spans")
    )
    rank = Window.partitionBy("g", "cell").orderBy("id")
    out = rows.join(own, ["g", "cell"]).withColumn("rank", F.col("first") + F.row_number().over(rank) - 1)
    out = out.withColumn("at", F.filter("spans", lambda s: (s.a <= F.col("rank")) & (F.col("rank") < s.b))[0])
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("at.shard").alias("shard"),
        (F.col("at.base") + F.col("rank") - F.col("at.a")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
