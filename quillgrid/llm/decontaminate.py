"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The test items' words go into one automaton. Every document's words are streamed through it: after each
word the automaton holds the longest suffix of the stream that occurs in an item. A match of `window`
words or more marks its last `window` words as hit; an item shorter than that is one window, found
through the automaton's suffix links. Documents are streamed in pieces, so memory doesn't grow with them.

Test items of more than PART_BYTES are dealt out to parts of about that size. The documents then pass the parts one
after the other, taking their spans and items along in a written table, so a worker holds one part's automata only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgrid.llm.common import buckets_for, cut, map_batches, running_total, utf8, written

WINDOW = 10
#: Bytes of test items that one automaton holds; more items go into more automata.
BLOCK_BYTES = 2 << 20
#: Bytes of test items that are broadcast together, some hundred times as many as automata in every worker.
PART_BYTES = 4 << 20
#: Documents whose share of hit words reaches this are dropped whole when text is removed.
DROP_COVERAGE = 0.5
#: Bytes of a document that are split into words at a time.
PIECE = 1 << 20

_SEPARATORS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_WORKER: dict[str, Automaton] = {}


def words_of(data: bytes):
    """The words of a text, lower-cased in A-Z, in lists of those of about PIECE bytes."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _SEPARATORS[data[end]] != 32:
            end += 1
        yield data[at:end].translate(_SEPARATORS).split()
        at = end


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                ids = [self.ids.setdefault(w, len(self.ids)) for w in words]
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        states = len(self.next)
        #: The state of each state's longest suffix that is no longer than the window.
        self.top = list(range(states))
        for v in sorted(range(1, states), key=self.size.__getitem__):
            if self.size[self.link[v]] >= window:
                self.top[v] = self.top[self.link[v]]
        self.holders: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for item, ids in coded:
            if len(ids) < window:
                v = 0
                for c in ids:
                    v = self.next[v][c]
                whole.setdefault(v, []).append((len(ids), item))
                continue
            v = n = 0
            for c in ids:
                v, n = self._step(v, n, c)
                if n >= window:
                    self.holders.setdefault(self.top[v], set()).add(item)
        #: Short items that end where a state does, along its suffix links.
        self.short: dict[int, list[tuple[int, str]]] = {}
        for v in sorted(range(1, states), key=self.size.__getitem__):
            if found := whole.get(v, []) + self.short.get(self.link[v], []):
                self.short[v] = found

    def _new(self, edges: dict[int, int], link: int, size: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._new(dict(self.next[q]), self.link[q], self.size[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, c, q)
        new = self._new({}, 0, self.size[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, c, q)
        return new

    def _step(self, v: int, n: int, c: int) -> tuple[int, int]:
        while v and c not in self.next[v]:
            v = self.link[v]
            n = self.size[v]
        to = self.next[v].get(c)
        return (0, 0) if to is None else (to, n + 1)

    def stream(self, data: bytes) -> tuple[int, list[list[int]], set[str], int]:
        """Words, the hit spans [from, to) of word numbers, the items met, and the longest match."""
        edges, link, size, window = self.next, self.link, self.size, self.window
        spans: list[list[int]] = []
        items: set[str] = set()
        at = v = n = longest = 0
        for words in words_of(data):
            for i, c in enumerate(map(self.ids.get, words), at + 1):
                if c is None:
                    v = n = 0
                    continue
                while v and c not in edges[v]:
                    v = link[v]
                    n = size[v]
                to = edges[v].get(c)
                if to is None:
                    v = n = 0
                    continue
                v = to
                n += 1
                hit = 0
                if n >= window:
                    hit = window
                    items |= self.holders[self.top[v]]
                if v in self.short:
                    for m, item in self.short[v]:
                        if m <= n:
                            hit = max(hit, m)
                            items.add(item)
                if hit:
                    longest = max(longest, n)
                    begin = i - hit
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append([begin, i])
            at += len(words)
        return at, spans, items, longest


class Matcher:
    """All test items, in automata of about BLOCK_BYTES each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.blocks, some, held = [], [], 0
        for item, data in items:
            some.append((item, [w for ws in words_of(data) for w in ws]))
            held += len(data)
            if held >= BLOCK_BYTES:
                self.blocks.append(Automaton(some, window))
                some, held = [], 0
        if some or not self.blocks:
            self.blocks.append(Automaton(some, window))

    def stream(self, data: bytes) -> tuple[int, list[list[int]], set[str], int]:
        n, spans, items, longest = self.blocks[0].stream(data)
        for block in self.blocks[1:]:
            _, more, met, most = block.stream(data)
            items, longest = items | met, max(longest, most)
            spans = merged(spans + more)
        return n, spans, items, longest


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def byte_spans(data: bytes, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Where the words of each span lie in the text."""
    out, todo = [], iter(spans)
    span, begin = next(todo, None), 0
    for i, m in enumerate(_WORD.finditer(data)):
        if span is None:
            break
        if i == span[0]:
            begin = m.start()
        if i == span[1] - 1:
            out.append((begin, m.end()))
            span = next(todo, None)
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at:a])
        at = b
    return b"".join([*keep, data[at:]])


def _matcher(key: str, held, window: int) -> Matcher:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Matcher(held.value, window)
    return _WORKER[key]


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[tuple[str, object, bool]]:
    """(key, broadcast rows, whether it is the last) of each part of the test items; at least one part."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item is not null and text is not null")
    size = F.octet_length("text") + F.octet_length("item")
    total = items.agg(F.sum(size)).first()[0] or 0
    count = 1
    if total > PART_BYTES:
        bucket = F.pmod(F.xxhash64("item", "text"), F.lit(buckets_for(total, PART_BYTES // 4)))
        placed = items.withColumn("all", F.lit(0)).withColumn("bucket", bucket).withColumn("size", size.cast("long"))
        placed = running_total(placed, ["all"], "bucket", [F.col("item"), F.col("text")], F.col("size"), "before")
        items = cut(placed.select("item", "text", F.floor(F.col("before") / PART_BYTES).alias("part")))
        count = items.agg(F.max("part")).first()[0] + 1
    for part in range(count):
        own = items.where(F.col("part") == part) if count > 1 else items
        rows = sorted((r.item, bytes(r.text)) for r in own.select("item", "text").collect())  # PART_BYTES and an item at most
        key = hashlib.sha256(repr((rows, window)).encode()).hexdigest()
        yield key, benchmark.sparkSession.sparkContext.broadcast(rows), part == count - 1


_WORDS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_BYTES = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _passed(state: DataFrame, key: str, held, window: int) -> DataFrame:
    """`state` (row, text) with n_words, words (spans of word numbers), items and longest: the hits of one part of
    the test items, added to those that `state` has already."""
    again = "words" in state.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = _matcher(key, held, window)
        out: list[list] = [[] for _ in range(4)]
        earlier = list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))) if again else None
        for i, data in enumerate(utf8(batch.column(1))):
            n, spans, items, longest = find.stream(data or b"")
            if earlier:
                words, met, most = earlier[i]
                spans, items, longest = merged(spans + [[w["a"], w["b"]] for w in words]), items | set(met), max(longest, most)
            for column, value in zip(out, (n, [{"a": a, "b": b} for a, b in spans], sorted(items), longest)):
                column.append(value)
        kinds = (pa.int64(), _WORDS, pa.list_(pa.string()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], ["row", "text", "n_words", "words", "items", "longest"]
        )

    row = state.schema["row"].dataType.simpleString()
    return map_batches(state, run, f"row {row}, text string, n_words long, words array<struct<a: long, b: long>>, items array<string>, longest long")


def _judged(state: DataFrame, key: str, held, window: int) -> DataFrame:
    """contamination()'s columns from `state`, as _passed() takes it, with the hits of the last part."""
    again = "words" in state.columns
    kind = state.schema["row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = _matcher(key, held, window)
        out: list[list] = [[] for _ in range(6)]
        earlier = list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)))) if again else None
        for i, data in enumerate(utf8(batch.column(1))):
            data = data or b""
            n, spans, items, longest = find.stream(data)
            if earlier:
                words, met, most = earlier[i]
                spans, items, longest = merged(spans + [[w["a"], w["b"]] for w in words]), items | set(met), max(longest, most)
            digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            where = [{"from": a, "to": b} for a, b in byte_spans(data, spans)] if spans else []
            for column, value in zip(out, (n, sum(b - a for a, b in spans), len(items), digest, longest, where)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _BYTES)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["id", "n_words", "n_hit", "n_items", "items_sha256", "longest_match", "spans"]
        )

    return map_batches(state, run, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, longest_match long, spans array<struct<from: long, to: long>>")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, spans.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. n_hit counts the
    words inside any occurrence of a window of `window` consecutive item words (an item of fewer words is
    one window; an item without words or with a null id or text is none). n_items counts the different
    items with an occurring window; items_sha256 hashes their ids, sorted as strings and joined by commas.
    spans are the hit byte ranges [from, to) of the UTF-8 text, longest_match the longest match in words.
    A null or empty text has no words. Rows may repeat and ids be null; other columns are ignored. Without
    benchmark rows nothing is hit; without documents the result is empty.
    """
    state = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    for key, held, last in _parts(benchmark, item_col, item_text_col, window):
        state = _judged(state, key, held, window) if last else written(_passed(state, key, held, window))
    return state.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "spans")


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    drop_coverage: float = DROP_COVERAGE,
    text_col: str = "text",
    length_col: str | None = None,
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """`docs` with the hit spans cut out of `text_col`, in the same columns.

    Documents of which at least `drop_coverage` of the words are hit are dropped. Removal is repeated until
    the seams hold no window either. `length_col`, if given, gets the new text's characters. Documents
    without a hit, null and empty texts among them, stay as they are.
    """
    parts = list(_parts(benchmark, item_col, item_text_col, window))
    if len(parts) == 1:
        key, held, _ = parts[0]
        return _cut_out(docs, lambda: _matcher(key, held, window), drop_coverage, text_col, length_col)
    done, todo, coverage = None, docs, drop_coverage
    while done is None or not todo.isEmpty():
        state = todo.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
        for key, held, _ in parts:
            state = written(_passed(state, key, held, window))
        clean = state.where(F.size("words") == 0).select("row.*")
        done = clean if done is None else done.unionByName(clean)
        hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w.b - w.a)
        kept = state.where((F.size("words") > 0) & (hit < F.lit(coverage) * F.col("n_words")))
        todo, coverage = written(_spans_cut(kept, docs.schema, text_col, length_col)), 2.0
    return done


def _spans_cut(marked: DataFrame, schema: StructType, text_col: str, length_col: str | None) -> DataFrame:
    """The rows of `marked`, as _passed() gives them, with their spans cut out, in the columns of `schema`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [without(data, byte_spans(data, [[w["a"], w["b"]] for w in words])) for data, words in zip(utf8(batch.column(1)), batch.column(2).to_pylist())]
        columns = {f.name: batch.column(0).field(i) for i, f in enumerate(batch.column(0).type)}
        columns[text_col] = pa.array(texts, pa.binary()).cast(pa.string())
        if length_col:
            columns[length_col] = pa.array([len(t.decode()) for t in texts], columns[length_col].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_batches(marked.select("row", "text", "words"), run, schema)


def _cut_out(docs: DataFrame, matcher, drop_coverage: float, text_col: str, length_col: str | None) -> DataFrame:
    """remove_contamination() with one part of test items, which cuts each text again until no window is left."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = matcher()
        texts, keep, changed = utf8(batch.column(at)), [], {}
        for i, data in enumerate(texts):
            n, spans, _, _ = find.stream(data or b"")
            hit = sum(b - a for a, b in spans)
            if hit and hit >= drop_coverage * n:
                continue
            keep.append(i)
            while spans:
                data = without(data, byte_spans(data, spans))
                changed[i] = data
                spans = find.stream(data)[1]
        if not changed and len(keep) == len(texts):
            return batch
        columns = list(batch.columns)
        if changed:
            new = [changed.get(i, x) for i, x in enumerate(texts)]
            columns[at] = pa.array(new, pa.binary()).cast(pa.string()).cast(batch.schema.field(at).type)
            if length_col:
                where = names.index(length_col)
                sizes = columns[where].to_pylist()
                columns[where] = pa.array([len(changed[i].decode()) if i in changed else s for i, s in enumerate(sizes)], batch.schema.field(where).type)
        out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return out.take(pa.array(keep, pa.int64()))

    return map_batches(docs, run, schema)


SQL = r"""
with
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sizes as (select distinct least(len(w), 10) as m from b where len(w) > 0),
windows as (
  select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as key
  from (select item_id, w, least(len(w), 10) as m, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
),
firsts as (select distinct split_part(key, ' ', 1) as f from windows),
starts as (select doc_id, w, i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) where w[i] in (select f from firsts)),
found as (
  select s.doc_id, s.i, s.m, windows.item_id
  from (select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as key from starts, sizes where i + m - 1 <= len(w)) s
  join windows on windows.m = s.m and windows.key = s.key
),
hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + m)) as p from found) group by doc_id),
met as (select doc_id, count(*) as n, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(hits.n, 0) as n_hit, coalesce(met.n, 0) as n_items,
       sha256(coalesce(met.ids, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
from d left join hits on hits.doc_id = d.doc_id left join met on met.doc_id = d.doc_id
"""
