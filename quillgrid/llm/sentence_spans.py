"""Substring deduplication by sliding sentence spans.

A text is split into sentences. Wherever `window` consecutive words hold no sentence's end, one ends after the word
with the smallest hash among them, so cuts follow from the words around them alone and a passage is cut alike wherever
it stands, even in the midst of a sentence. A span is the shortest run of sentences with `least_words` words and
`least_sentences` sentences that starts at a sentence, or that ends at one; so the spans of a run that is repeated
reach from its first sentence to its last, and any shared run of over 50 words holds one. Every span is hashed to 96
bits, the hashes are joined over all documents, and a sentence is removed if any repeated span other than the first of
its kind covers it; first is the smallest (document id, place).

A document's spans are kept as arrays, one row per document. A frequent-items sketch names the crowded hashes, at
most MAX_HEAVY; their first occurrences come from an aggregation with map-side combining, and all others of theirs
are then known where they are read. All other hashes, whose groups the sketch's error bound keeps small, are
ordered in one shuffle. Only texts that lose a sentence meet their marks by shuffling, for as long as their keys are
few enough to be broadcast; the others pass by.
"""

from __future__ import annotations

import operator
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.common import cut, map_batches, shared_folder, utf8

LEAST_WORDS, LEAST_SENTENCES = 20, 2
#: Words of which the one with the smallest hash ends a sentence, if no other ends there.
WINDOW = 14
#: Counters of the sketch, most hashes that are broadcast, and copies from which a hash counts as crowded.
COUNTERS, MAX_HEAVY, LEAST_COPIES = 8192, 1024, 256
#: Hashes of documents that lose a sentence, and ids of several texts, of 8 bytes, that are broadcast at most.
MOST_MARKED, MOST_REPEATED = 1 << 21, 1 << 20
#: Windows whose smallest hashes are taken at a time.
BLOCK = 1 << 16
#: Chinese and Japanese characters (U+3000 to U+9FFF): each is a word of its own.
_IDEOGRAPH = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}")
_IDEOGRAPH_WORDS = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|[^\s\xe3-\xe9]+")
_WORDS = re.compile(rb"\S+")
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_IDEOGRAPH_STOPS = (b".", b"!", b"?", "\u3002".encode(), "\uff01".encode(), "\uff1f".encode())


def split(data: bytes, window: int = WINDOW) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and the number of words before each sentence's end.

    Words are runs of anything but ASCII white space, and single ideographs. A sentence ends after a word that ends
    with a full stop, an exclamation or a question mark, at a line's end, and at the cuts.
    """
    special = _IDEOGRAPH.search(data) is not None
    words: list[bytes] = []
    lines = []
    for line in data.split(b"\n"):
        own = _IDEOGRAPH_WORDS.findall(line) if special else line.split()
        if own:
            words += own
            lines.append(len(words) - 1)
    n = len(words)
    if not n:
        return words, np.zeros(0, np.int64)
    if special:
        stops = np.fromiter((w.endswith(_IDEOGRAPH_STOPS) for w in words), bool, n)
    else:
        stops = _STOPS[np.frombuffer(bytes(map(operator.itemgetter(-1), words)), np.uint8)]
    stops[lines] = True
    if n >= window:
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, n)
        before = np.concatenate([[0], np.cumsum(stops)])
        free = np.flatnonzero(before[window - 1 : n] == before[: n - window + 1])
        view = sliding_window_view(hashes, window)
        for at in range(0, len(free), BLOCK):
            some = free[at : at + BLOCK]
            stops[some + window - 1 - view[some][:, ::-1].argmin(axis=1)] = True
    return words, np.flatnonzero(stops) + 1


def places(data: bytes, window: int = WINDOW) -> list[tuple[int, int]]:
    """The byte range of every sentence."""
    words, ends = split(data, window)
    find = _IDEOGRAPH_WORDS if _IDEOGRAPH.search(data) else _WORDS
    spots = [m.span() for m in find.finditer(data)]
    begins = [0, *ends[:-1].tolist()] if len(ends) else []
    return [(spots[a][0], spots[b - 1][1]) for a, b in zip(begins, ends.tolist())]


def spans(ends: np.ndarray, least_words: int = LEAST_WORDS, least_sentences: int = LEAST_SENTENCES) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence (inclusive) of every span: the shortest from each start, and up to each end."""
    upto, n = np.concatenate([[0], ends]), len(ends)
    each = np.arange(n)
    last = np.maximum(np.searchsorted(upto, upto[:-1] + least_words) - 1, each + least_sentences - 1)
    first = np.minimum(np.searchsorted(upto, upto[1:] - least_words, "right") - 1, each - least_sentences + 1)
    codes = np.unique(np.concatenate([(each * n + last)[last < n], (first * n + each)[first >= 0]]))
    return codes // max(n, 1), codes % max(n, 1)


def span_hashes(docs: DataFrame, least_words: int, least_sentences: int, window: int) -> DataFrame:
    """(id, key, h1, h2, a, more): `docs` (id, key, text) with arrays of each span's hash halves, of its first
    sentence and of the number of those after it."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes_of, first, more, hashes = [0], [], [], []
        for data in utf8(batch.column(2)):
            words, ends = split(data or b"", window)
            a, b = spans(ends, least_words, least_sentences)
            if len(a):
                begins = [0, *ends[:-1].tolist()]
                own = b"".join(xxhash.xxh3_128_digest(b" ".join(words[i:j])) for i, j in zip(begins, ends.tolist()))
                hashes += [xxhash.xxh3_128_digest(own[i:j]) for i, j in zip((a * 16).tolist(), (b * 16 + 16).tolist())]
                first.append(a)
                more.append(b - a)
            sizes_of.append(len(hashes))
        halves = np.frombuffer(b"".join(hashes), np.dtype([("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")]))
        offsets = pa.array(sizes_of, pa.int32())
        joined = (np.concatenate(x) if x else np.zeros(0) for x in (first, more))
        columns = (np.ascontiguousarray(halves["h1"]), np.ascontiguousarray(halves["h2"]), *(x.astype(k) for x, k in zip(joined, (np.int32, np.int16))))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "key", "h1", "h2", "a", "more"])

    return map_batches(docs, run, f"id {kind}, key int, h1 array<long>, h2 array<int>, a array<int>, more array<smallint>")


def repeats(found: DataFrame) -> DataFrame:
    """(id, key, a, more) of all spans of span_hashes() but the first of each kind."""
    sketch = found.select(F.explode("h1").alias("h1")).agg(F.expr(f"approx_top_k(h1, {MAX_HEAVY}, {COUNTERS})").alias("t")).select(F.explode("t").alias("t"))
    crowded = [r.h1 for r in sketch.where(F.col("t.count") >= LEAST_COPIES).select(F.col("t.item").alias("h1")).collect()]  # MAX_HEAVY at most
    every = found.select("id", "key", F.explode(F.arrays_zip("h1", "h2", "a", "more")).alias("s")).select("s.h1", "s.h2", "id", "key", "s.a", "s.more")
    place, heavy = F.struct("id", "key", "a"), F.col("h1").isin(crowded) if crowded else F.lit(False)
    columns = ["id", "key", "a", "more"]
    order = Window.partitionBy("h1", "h2").orderBy("id", "key", "a")
    packed = every.where(~heavy).select("h1", "h2", "id", "key", (F.col("a").cast("long") * 65536 + F.col("more")).alias("a"))
    later = packed.withColumn("before", F.min(place).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~place.eqNullSafe(F.col("before")))
    later = later.select("id", "key", F.floor(F.col("a") / 65536).cast("int").alias("a"), (F.col("a") % 65536).cast("smallint").alias("more"))
    if not crowded:
        return later
    firsts = every.where(heavy).groupBy("h1", "h2").agg(F.min(place).alias("f")).select(F.xxhash64("h1", "h2", "f.id", "f.key", "f.a").alias("row"))
    first = F.xxhash64("h1", "h2", "id", "key", "a").isin([r.row for r in firsts.collect()])  # a row for each crowded hash
    return every.where(heavy & ~first).select(*columns).unionAll(later.select(*columns))


def keyed(picked: DataFrame) -> DataFrame:
    """`picked` (id, key, text) with key 0 where no other text has the id, so that spans needn't carry it."""
    texts = picked.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    several = cut(texts.select(F.col("id").alias("rid"), F.lit(True).alias("several")))
    if several.count() > MOST_REPEATED:
        return picked
    found = picked.join(F.broadcast(several), F.col("id").eqNullSafe(F.col("rid")), "left")
    return found.select("id", F.when(F.col("several"), F.col("key")).otherwise(0).alias("key"), "text")


def span_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_sentences: int = LEAST_SENTENCES,
    window: int = WINDOW,
) -> DataFrame:
    """One row per input row: id, n_sentences, n_removed, clean_text.

    clean_text is the text without the sentences that a repeated span other than the first of its kind
    covers, whether it repeats in another document or in its own; the white space between sentences stays.
    Texts with fewer than `least_words` words or `least_sentences` sentences have no span and stay as they
    are; a null text stays null and has no sentences. In texts without spaces every ideograph is a word.
    Rows that repeat id and text are one document; rows that repeat an id with another text are two, the one
    with the smaller hash coming first; the hash has 32 bits, so of 4 billion such pairs one is taken for one
    document. A null id comes before all others. Other columns are ignored; an empty table gives an empty result.
    """
    picked = keyed(docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("key"), F.col(text_col).alias("text")))
    folder = f"{shared_folder(docs.sparkSession)}/spans-{uuid.uuid4().hex}"
    span_hashes(picked, least_words, least_sentences, window).where(F.size("h1") > 0).write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder)
    marks = repeats(found).groupBy("id", "key").agg(F.collect_set(F.struct("a", (F.col("a") + F.col("more")).alias("b"))).alias("marks"))  # one document's own
    marks = cut(marks.select(F.col("id").alias("mid"), F.col("key").alias("mkey"), "marks"))
    kind = picked.schema["id"].dataType.simpleString()
    marked, rest = picked, None
    if marks.count() <= MOST_MARKED:
        hashes = F.broadcast(marks.select(F.xxhash64("mid", "mkey").alias("h")).distinct())
        here = F.xxhash64("id", "key") == F.col("h")
        marked, rest = picked.join(hashes, here, "left_semi"), picked.join(hashes, here, "left_anti")
    joined = marked.join(marks, F.col("id").eqNullSafe(F.col("mid")) & (F.col("key") == F.col("mkey")), "left").select("id", "text", "marks")
    if rest is not None:
        joined = joined.unionByName(rest.select("id", "text", F.lit(None).cast(joined.schema["marks"].dataType).alias("marks")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for data, own in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            if own:
                spots, gone = places(data, window), {i for m in own for i in range(m["a"], m["b"] + 1)}
                out[0].append(len(spots))
                out[1].append(len(gone))
                out[2].append(_without(data, spots, gone))
            else:
                out[0].append(len(split(data or b"", window)[1]))
                out[1].append(0)
                out[2].append(data)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())],
            ["id", "n_sentences", "n_removed", "clean_text"],
        )

    out = map_batches(joined, run, f"id {kind}, n_sentences long, n_removed long, clean_text string")
    return out.withColumnRenamed("id", id_col)


def _without(data: bytes, spots: list[tuple[int, int]], gone: set[int]) -> bytes:
    keep, at = [], 0
    for i, (a, b) in enumerate(spots):
        if i in gone:
            keep.append(data[at:a])
            at = b
    return b"".join([*keep, data[at:]])
