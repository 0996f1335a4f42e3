"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring encodings are spliced at a
common stable boundary: a place between a character that isn't white space and an ASCII white-space
character, inside both chunks, at which both have a token boundary, and on both sides of which both have
the same tokens. Neither normalisation (NFC composes nothing with a space and reorders no marks across
one) nor the pre-tokeniser's pattern (no alternative matches a space after another character) nor a merge
(none leaves its pre-token) crosses such a place, so left of it the earlier chunk's tokens are those of
the whole text and right of it the later chunk's. Where the overlap holds no such place, it is widened,
in the end to the whole rest of the text.

Ordinary texts are split at the same boundaries. Since their words are encoded independently, each
different word of a task is encoded once.
"""

from __future__ import annotations

import bisect
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import map_batches

#: Characters per chunk and of the first overlap tried.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Words that a worker remembers, and the longest one.
REMEMBERED, LONGEST = 300_000, 64

_BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")
_WORKER: dict[str, Counter] = {}


class Counter:
    """Counts one tokenizer file's tokens; made once per worker."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        self.seen: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.words = self.stable = False
            return
        from tokenizers import Tokenizer

        self.pieces = None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.stable, self.words = _proofs(spec)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as one encoding of the whole text gives them."""
        if self.pieces is not None:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)] if texts else []
        out = [0] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if self.stable and len(text) > self.chunk:
                out[i] = self.spliced(text)
            else:
                plain.append(i)
        if self.words:
            for i, n in zip(plain, self._by_word([texts[i] for i in plain])):
                out[i] = n
        else:
            for at in range(0, len(plain), 64):
                some = plain[at : at + 64]
                for i, e in zip(some, self.tokenizer.encode_batch([texts[i] for i in some], add_special_tokens=False)):
                    out[i] = len(e)
        return out

    def _by_word(self, texts: list[str]) -> list[int]:
        seen, out = self.seen, []
        for text in texts:
            words = text.split(" ")
            new = [w for w in set(words) if w not in seen]
            if new:
                if len(seen) > REMEMBERED:
                    seen.clear()
                    new = list(set(words))
                short = [w for w in new if len(w) <= LONGEST]
                for at in range(0, len(short), 1000):
                    some = short[at : at + 1000]
                    seen.update(dict.fromkeys(some, 0))
                    coded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                    for w in coded.word_ids:
                        seen[some[w]] += 1
                if len(short) < len(new):
                    long = {w: len(self.tokenizer.encode(w, add_special_tokens=False)) for w in new if len(w) > LONGEST}
                    out.append(sum(long[w] if w in long else seen[w] for w in words))
                    continue
            out.append(sum(map(seen.__getitem__, words)))
        return out

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], list[int], list[int]]:
        coded = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return coded.ids, [start + a for a, _ in coded.offsets], [start + b for _, b in coded.offsets]

    def spliced(self, text: str) -> int:
        """Tokens of a long text from overlapping chunks."""
        total, size = 0, len(text)
        left, reach = 0, min(size, self.chunk)
        a = self._encode(text, 0, reach)
        since, point = 0, 0  # a's tokens before this index, the text before this place, are counted
        while reach < size:
            overlap = self.overlap
            while True:
                begin = max(left, reach - overlap)
                until = min(size, reach + self.chunk)
                b = self._encode(text, begin, until)
                if place := self._common(text, a, b, begin, reach):
                    break
                self.widened += 1
                if begin == left:  # the whole earlier chunk is inside: it is superseded
                    place = (since, bisect.bisect_left(b[1], point), point)
                    break
                overlap *= 4
            total += place[0] - since
            a, since, point, left, reach = b, place[1], place[2], begin, until
        return total + len(a[0]) - since

    def _common(self, text, a, b, begin: int, reach: int) -> tuple[int, int, int] | None:
        """Indexes into both encodings at the overlap's last proven boundary and its place, or None.

        Both must agree on the tokens between the first and the last boundary of the overlap.
        """
        places = [m.start() for m in _BOUNDARY.finditer(text, begin + 1, reach)]
        places = [p for p in places if p > begin]
        if len(places) < 2:
            return None
        low, high = places[0], places[-1]
        ends = []
        for ids, starts, stops in (a, b):
            i, j = bisect.bisect_left(starts, low), bisect.bisect_left(starts, high)
            if (i and stops[i - 1] > low) or (j and stops[j - 1] > high):
                return None
            ends.append((i, j))
        (ai, aj), (bi, bj) = ends
        if a[0][ai:aj] != b[0][bi:bj]:
            return None
        return aj, bj, high


def _proofs(spec: dict) -> tuple[bool, bool]:
    """Whether the module's argument holds for a tokenizer file, and whether its words are independent.

    The argument needs a normaliser made of NFC, lower-casing and white-space runs only, a splitting
    pattern, and added tokens that take no white space in. Words are independent if, besides, white
    space is dropped.
    """

    def parts(step, key):
        return [] if step is None else step.get(key, [step]) if step.get("type") == "Sequence" else [step]

    norms = parts(spec.get("normalizer"), "normalizers")
    pres = parts(spec.get("pre_tokenizer"), "pretokenizers")
    plain = all(
        n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
        for n in norms
    )
    added = all(not (t.get("lstrip") or t.get("rstrip") or " " in t["content"]) for t in spec.get("added_tokens", []))
    splits = [p for p in pres if p["type"] == "Split"]
    drops = any(p["behavior"] == "Removed" and p["invert"] and "[^\\s\\p{L}\\p{N}]+" in p["pattern"].get("Regex", "") and " ?" not in p["pattern"]["Regex"] and "\\s+" not in p["pattern"]["Regex"] for p in splits)
    bytes_level = any(p["type"] == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space") for p in pres)
    return plain and added and (drops or bytes_level), plain and added and drops


def counter(path: str, chunk: int, overlap: int) -> Counter:
    key = f"{path}\0{chunk}\0{overlap}"
    if key not in _WORKER:
        _WORKER[key] = Counter(path, chunk, overlap)
    return _WORKER[key]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a tokenizers .json or sentencepiece .model file that every executor has.
    Tokens are those of the whole text without added special tokens; special strings in a text count as
    the library's default has them. A null or empty text has no bytes and no tokens; ids may be null or
    repeat; other columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        counts = counter(tokenizer, chunk, overlap).count([t or "" for t in texts])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")),
        run,
        f"id {kind}, n_bytes long, n_tokens long",
    )
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
