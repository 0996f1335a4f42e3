"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's UTF-8 bytes from both sides, its states running on across words, and gives every byte
position a label distribution; a document's probabilities are the mean of those of its letters' positions. Texts are
read in segments of SEGMENT bytes, cut between characters by their place in the text alone; on each side a segment is
read on into CONTEXT bytes more of the text, which label nothing but carry the states to its borders. Many segments run
side by side. It is trained by backpropagation through time with Adam, on the driver, from a bounded sample of labelled
documents of every language. Gates and candidates use x / (1 + |x|), scaled to 0..1 and -1..1.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import map_batches, utf8

#: Bounds of the training sample: documents of each language, and windows of each document, spread over its whole text.
SAMPLE_DOCS, SAMPLE_WINDOWS = 800, 4
HIDDEN, EPOCHS, BATCH, RATE, SEED = 8, 4, 192, 0.02, 7
#: Batches that a training takes at least, in more epochs where the sample is small.
LEAST_BATCHES = 220
#: Bytes of a training window; of a segment that is labelled at once; and of the text read on each side of it.
WINDOW, SEGMENT, CONTEXT = 96, 256, 32
#: Segments that run side by side, and those that are put in order of length before.
LANES, TOGETHER = 1024, 8192
#: A score counts as too low for a language if it is below MARGIN times that of all but REJECTED of the rightly
#: labelled training windows.
REJECTED, MARGIN = 0.0005, 0.9
UNKNOWN = "und"

_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_WORKER: dict[str, Network] = {}


def _padded(texts: list[bytes]) -> np.ndarray:
    """Bytes as an array (longest, texts), zeros after each text; a zero byte of a text becomes a space."""
    width = max(map(len, texts))
    joined = b"".join(t.replace(b"\0", b" ").ljust(width, b"\0") for t in texts)
    return np.ascontiguousarray(np.frombuffer(joined, np.uint8).reshape(len(texts), width).T)


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _starts(data: bytes, places: list[int]) -> list[int]:
    """Each place, moved back to the start of the character that it lies in."""
    out = []
    for at in places:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return out


class Network:
    """One gated recurrent layer in each direction and a softmax over both states at each position.

    Arrays hold a unit, gate or label in each row and a text in each column.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        #: The score below which a text counts as of no language.
        self.least = 0.0
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (len(labels), 2 * hidden)).astype(np.float32)
        self.p["c"] = np.zeros((len(labels), 1), np.float32)

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (steps, hidden, texts) of one direction; x is (steps, texts).

        The backward state is held at zero in a text's padding, so a text's labels don't depend on its batch.
        """
        steps, n, k = *x.shape, self.hidden
        inputs, weights = self.p[f"x{side}"], self.p[f"h{side}"]
        h, out = np.zeros((k, n), inputs.dtype), np.empty((steps, k, n), inputs.dtype)
        live = (x != 0).astype(inputs.dtype)
        padded = side == "b" and not live.all()
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a, b = inputs.take(x[t], axis=1), weights @ h
            s = _soft(a[: 2 * k] + b[: 2 * k])
            r, z = 0.5 + 0.5 * s[:k], 0.5 + 0.5 * s[k:]
            c = _soft(a[2 * k :] + r * b[2 * k :])
            new = np.add(c, z * (h - c), out=out[t])
            if padded:
                new *= live[t]
            if keep is not None:
                keep.append((t, h, s, c, b[2 * k :]))
            h = new
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Label distributions (steps, labels, texts) of every position."""
        k, o = self.hidden, self.p["o"]
        scores = o[:, :k] @ self._run(x, "f") + o[:, k:] @ self._run(x, "b") + self.p["c"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by backpropagation through time; y: each text's label, weight: (steps, texts)."""
        k, n, keeps = self.hidden, x.shape[1], {"f": [], "b": []}
        states = np.concatenate([self._run(x, s, keeps[s]) for s in "fb"], axis=1)
        scores = self.p["o"] @ states + self.p["c"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        scores /= scores.sum(axis=1, keepdims=True)
        w = weight / max(weight.sum(), 1e-9)
        loss = float(-(np.log(scores[:, y, np.arange(n)] + 1e-9) * w).sum())
        d = scores
        d[:, y, np.arange(n)] -= 1
        d *= w[:, None]
        out = {"o": np.einsum("tln,tkn->lk", d, states, optimize=True), "c": d.sum(axis=(0, 2))[:, None]}
        back = self.p["o"].T @ d
        for at, side in enumerate("fb"):
            gh, weights = np.zeros_like(self.p[f"h{side}"]), self.p[f"h{side}"]
            moved = np.empty((len(x), 3 * k, n), weights.dtype)
            dh = np.zeros((k, n), weights.dtype)
            live = (x != 0).astype(weights.dtype) if side == "b" else np.ones(x.shape, weights.dtype)
            for t, h, s, c, u in reversed(keeps[side]):
                dh = (dh + back[t, at * k : (at + 1) * k]) * live[t]
                r, z = 0.5 + 0.5 * s[:k], 0.5 + 0.5 * s[k:]
                steep = 0.5 * (1 - np.abs(s)) ** 2
                dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
                da = np.concatenate([dc * u * steep[:k], dh * (h - c) * steep[k:], dc], out=moved[t])
                db = np.concatenate([da[: 2 * k], dc * r])
                gh += db @ h.T
                dh = dh * z + weights.T @ db
            flat = x.ravel()
            out[f"x{side}"] = np.stack([np.bincount(flat, moved[:, i].ravel(), 256) for i in range(3 * k)]).astype(weights.dtype)
            out[f"h{side}"] = gh
        return loss, out

    def train(self, windows: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        """Adam over batches of windows of like length; rare labels weigh up to four times as much."""
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        lengths = np.array([len(w) for w in windows])
        counts = np.bincount(labels, minlength=len(self.labels))
        weigh = np.minimum(4, counts.max() / np.maximum(counts, 1)).astype(np.float32)[labels]
        epochs = max(epochs, -(-LEAST_BATCHES * BATCH // max(len(windows), 1)) if len(windows) >= BATCH else LEAST_BATCHES)
        for epoch in range(epochs):
            order = np.argsort(lengths + rng.random(len(windows)) * 8)
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for b in rng.permutation(len(batches)):
                own = batches[b]
                x = _padded([windows[i] for i in own])
                _, g = self.gradients(x, labels[own], _LETTER[x] * weigh[own])
                step += 1
                now = rate / (1 + 3 * epoch / epochs)
                for k, v in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.001 * (g[k] ** 2 - s[k])
                    v -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def _pool(self, lanes: list[tuple[int, bytes, int, int]], totals: np.ndarray) -> None:
        """Adds the segments' distributions at letters to their documents' totals, and the number of those letters."""
        lanes.sort(key=lambda lane: len(lane[1]))
        for at in range(0, len(lanes), LANES):
            own = lanes[at : at + LANES]
            x = _padded([lane[1] for lane in own])
            place = np.arange(len(x))[:, None]
            begin, end = (np.array([lane[i] for lane in own]) for i in (2, 3))
            w = _LETTER[x] * ((place >= begin) & (place < end))
            found = np.einsum("tln,tn->nl", self.label(x), w)
            np.add.at(totals, [lane[0] for lane in own], np.column_stack([found, w.sum(axis=0)]))

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """(label, score) of each text."""
        totals = np.zeros((len(texts), len(self.labels) + 1))
        lanes: list[tuple[int, bytes, int, int]] = []
        for i, data in enumerate(texts):
            for begin, end, left, right in segments(data) if data and _has_letter(data) else ():
                lanes.append((i, data[left:right], begin - left, end - left))
                if len(lanes) >= TOGETHER:
                    self._pool(lanes, totals)
                    lanes = []
        if lanes:
            self._pool(lanes, totals)
        out = []
        for total in totals:
            if not total[-1]:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmax(total[:-1]))
            out.append((self.labels[best], round(float(min(1.0, total[best] / total[-1])), 6)))
        return out


def segments(data: bytes):
    """(begin, end, left, right) of a text's segments: the bytes labelled, and those read."""
    n = len(data)
    count = -(-n // SEGMENT)
    cuts = _starts(data, [i * n // count for i in range(count + 1)])
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            left, right = _starts(data, [max(0, begin - CONTEXT), min(n, end + CONTEXT)])
            yield begin, end, left, right


def _has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER.search(data)) or not data.isascii() and any(map(str.isalpha, data.decode("utf-8", "replace")))


def held_out(id_col: str) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_windows: int = SAMPLE_WINDOWS,
    hidden: int = HIDDEN,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> Network | None:
    """A network trained on labelled documents that aren't held out; None if there are none with a letter.

    Its `least` is MARGIN times the score that all but REJECTED of the sample's rightly labelled windows reach.

    The sample is bounded: of each language about `sample_docs` documents by a hash of the id (all, if there are
    fewer), `sample_windows` windows of WINDOW bytes of each, spread evenly over its whole text. The labels are the
    sample's languages; the driver holds one count for each of them.
    """
    fit = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), held_out(id_col).alias("out"))
    fit = fit.where("lang is not null and text is not null and not out")
    counts = {r.lang: r.n for r in fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, sample_docs / n) * (1 << 30)))])
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.element_at(shares, F.col("lang"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, windows, rows = batch.column(1).to_pylist(), [], []
        for lang, data in zip(langs, utf8(batch.column(0))):
            for at in _starts(data, sorted({i * max(0, len(data) - WINDOW) // max(1, sample_windows - 1) for i in range(sample_windows)})):
                own = data[at : _starts(data, [at + WINDOW])[0]]
                if _has_letter(own):
                    windows.append(own)
                    rows.append(lang)
        return pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(rows, pa.string())], ["w", "lang"])

    rows = map_batches(fit.where(part).select("text", "lang"), run, "w binary, lang string").collect()  # a bounded fit
    rows = sorted((bytes(r.w), r.lang) for r in rows)
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    net = Network(labels, hidden, seed)
    code = {lang: i for i, lang in enumerate(labels)}
    net.train([w for w, _ in rows], np.array([code[lang] for _, lang in rows]), epochs, seed=seed)
    right = [score for (found, score), (_, lang) in zip(net.predict([w for w, _ in rows]), rows) if found == lang]
    net.least = MARGIN * float(np.quantile(right, REJECTED)) if right else 0.0
    return net


def _loaded(key: str, held) -> Network:
    if key not in _WORKER:
        _WORKER.clear()
        labels, hidden, p = held.value
        _WORKER[key] = net = Network(labels, hidden)
        net.p = p
    return _WORKER[key]


def predictor(net: Network | None, spark):
    """A function of a string array that gives (lang, score) pairs, for use in executors."""
    if net is None:
        return lambda column: [(UNKNOWN, 0.0)] * len(column)
    import hashlib

    key = hashlib.sha256(b"".join(net.p[k].tobytes() for k in sorted(net.p)) + repr(net.labels).encode()).hexdigest()
    held = spark.sparkContext.broadcast((net.labels, net.hidden, net.p))  # some 60 kB, whatever the input
    return lambda column: _loaded(key, held).predict(utf8(column))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    lang_pred is one of the network's labels; `und` with score 0 if the text is null or has no letter, or if
    nothing could be learned. score is the label's mean probability over the letters' positions of the whole
    text. Repeated rows, null ids and extra columns do no harm; an empty table gives an empty result.
    """
    predict = predictor(net, docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = predict(batch.column(2))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            ["id", "held_out", "lang_pred", "score"],
        )

    picked = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = map_batches(picked, run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, net: Network | None, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language with a score of at least `least`.

    Where `least` isn't given it is the network's own. Without a network, that is if nothing could be learned, the
    rows whose text has a letter.
    """
    predict = predictor(net, docs.sparkSession)
    at, learned = docs.columns.index(text_col), net is not None
    bound = least if least is not None else net.least if learned else 0.0

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if learned:
            keep = [lang != UNKNOWN and score >= bound for lang, score in predict(batch.column(at))]
        else:
            keep = [bool(data) and _has_letter(data) for data in utf8(batch.column(at))]
        return batch if all(keep) else batch.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)
