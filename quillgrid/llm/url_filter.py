"""URL filtering: rules on hosts and paths, and logistic regression on hashed character n-grams for the rest.

The model is trained on the driver from a small labelled URL table, given or the one in labelled_urls.csv. It weighs
the hashed 3- to 5-grams of host and path, each with marks at its ends; a URL of unknown n-grams is allowed.
"""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import map_batches, spread_join, utf8

SIZES, DIMENSIONS, EPOCHS, RATE, SEED = (3, 4, 5), 1 << 16, 40, 0.5, 11
BATCH = 32
#: (action, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules that are tested one by one in the plan; more are joined on the hosts' suffixes.
MOST_RULES = 500


def labelled_table() -> list[tuple[str, int]]:
    """The small labelled table beside this module: (url, 1 for blocked)."""
    with (Path(__file__).parent / "labelled_urls.csv").open(encoding="utf-8", newline="") as f:
        return [(r["url"], int(r["blocked"])) for r in csv.DictReader(f)]


def split_url(url: str | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    if not url or "://" not in url:
        return b"", b""
    rest = url.split("://", 1)[1].encode()
    ends = [i for i in (rest.find(b"/"), rest.find(b"?"), rest.find(b"#")) if i >= 0]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    stops = [i for i in (tail.find(b"?"), tail.find(b"#")) if i >= 0]
    return host.lower(), tail[: min(stops, default=len(tail))]


def features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows, and the row of each."""
    joined = [b"\x02" + h + b"\x03" + p + b"\x04" for h, p in zip(hosts, paths)]
    data = np.frombuffer(b"".join(joined), np.uint8).astype(np.uint64)
    sizes = np.array([len(j) for j in joined])
    row = np.repeat(np.arange(len(joined)), sizes)
    path = np.frombuffer(b"".join(bytes(len(h) + 2) + bytes([1]) * (len(p) + 1) for h, p in zip(hosts, paths)), np.uint8)
    grams, rows = [], []
    for n in SIZES:
        last = len(data) - n + 1
        if last <= 0:
            continue
        h = np.full(last, n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(1_000_003)) ^ data[i : i + last]
        h = (h * np.uint64(2) + path[:last]) * np.uint64(0x9E3779B97F4A7C15)
        whole = row[:last] == row[n - 1 :]
        grams.append((h >> np.uint64(40))[whole] % np.uint64(DIMENSIONS))
        rows.append(row[:last][whole])
    return np.concatenate(grams).astype(np.int64), np.concatenate(rows)


def scores(weights: np.ndarray, bias: float, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
    grams, rows = features(hosts, paths)
    total = np.bincount(rows, weights[grams], len(hosts))
    return total / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(hosts)))) + bias


def train(table: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression, by Adagrad over batches."""
    rng = np.random.default_rng(seed)
    parts = [split_url(u) for u, _ in table]
    labels = np.array([y for _, y in table], float)
    weights, bias = np.zeros(DIMENSIONS), 0.0
    squares, bias_squares = np.full(DIMENSIONS, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(table))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            hosts, paths = [parts[i][0] for i in own], [parts[i][1] for i in own]
            grams, rows = features(hosts, paths)
            root = np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(own))))
            z = np.bincount(rows, weights[grams], len(own)) / root + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            g = np.bincount(grams, (error / root)[rows], DIMENSIONS) + 1e-5 * weights
            squares += g * g
            weights -= rate * g / np.sqrt(squares) * (g != 0) * 0.2
            bias_squares += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_squares) * 0.2
    return weights, bias


@lru_cache(maxsize=1)
def built_in_model() -> tuple[np.ndarray, float]:
    return train(labelled_table())


def host_and_path(url: str) -> tuple[Column, Column]:
    """Spark expressions of split_url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(action, rule), or null. Of equally long ones the longer host wins, then order."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:]))
    found = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(a).alias("action"), F.lit(h + p).alias("rule"))) for a, h, p in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<action: string, rule: string>")


def joined_rules(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """`parsed` (id, host, path) with matched_rule()'s `found`, for a table of rules (action, host, path) of any size.

    Every different host and path meets the rules of each suffix of its host; a host's own rules are one row.
    """
    own = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("width"), "action", "host", "path")
    known = rules.where("host is not null and path is not null").groupBy(F.col("host").alias("suffix")).agg(F.collect_set(own).alias("own"))
    places = parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    held = asked.groupBy("suffix").agg(F.count(F.lit(1)).alias("held"))
    met = spread_join(asked, known.join(held, "suffix"), "suffix")
    fits = F.filter("own", lambda r: F.col("path").startswith(r.path))
    best = met.select("host", "path", F.array_max(fits).alias("best")).where("best is not null").groupBy("host", "path").agg(F.max("best").alias("best"))
    found = F.when(F.col("best").isNotNull(), F.struct(F.col("best.action").alias("action"), F.concat("best.host", "best.path").alias("rule")))
    facts = places.join(best, ["host", "path"], "left").select("host", "path", found.alias("found"), F.col("rows").alias("held"))
    return spread_join(parsed, facts, ["host", "path"])


def filter_urls(
    pages: DataFrame,
    rules=RULES,
    labelled: list[tuple[str, int]] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: id, host, path, rule, score, verdict.

    The longest fitting rule decides; where none fits, the model blocks from probability `threshold` on. A
    null url or one without `://` has an empty host and path and is judged by the model alone; score is the
    model's probability for every row. Repeated rows, null ids and other columns do no harm; an empty table
    gives an empty result. `labelled` holds (url, 1 for blocked) pairs and fits in the driver's memory. `rules` are
    (action, host, path) tuples or a table of such rows, of any size.
    """
    weights, bias = train(labelled) if labelled else built_in_model()
    held = pages.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # DIMENSIONS numbers
    host, path = host_and_path("url")
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > MOST_RULES:
        many = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
        ruled = joined_rules(parsed, many.select("action", "host", "path"))
    else:
        ruled = parsed.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.action").alias("action"))
    kind = ruled.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, b = held.value
        z = scores(w, b, utf8(batch.column(1)), utf8(batch.column(2)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*batch.schema.names, "score"])

    out = map_batches(ruled, run, f"id {kind}, host string, path string, rule string, action string, score double")
    verdict = F.coalesce("action", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "score", verdict.alias("verdict"))
