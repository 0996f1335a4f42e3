import hashlib
import random
import re

import xxhash
from conftest import SF, duck_rows, rows

from quillgrid.llm import exact_dedup, queries, sentence_spans, simhash
from quillgrid.llm.components import connected_components

from slow_spans import slow_removed


def test_exact_dedup_equals_sql(spark, duck):
    columns, wanted = duck_rows(duck, exact_dedup.SQL)
    out = queries.op8_exact_dedup(spark, SF)
    assert sorted(out.columns) == columns and rows(out) == wanted


def test_exact_dedup_heavy_groups_and_edges(spark):
    data = [(i, "big  copy") for i in range(500, 300, -1)] + [(7, "big\tcopy"), (None, "big copy"), (7, "big copy"), (1, None), (2, ""), (3, " "), (9, "x"), (9, "x")]
    random.Random(1).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 as digest", "2 as kept", "3 as id")
    out = exact_dedup.exact_dedup(docs, least_copies=50).collect()
    assert len(out) == len(data)
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    big = by[hashlib.sha256(b"big copy").hexdigest()]
    assert {(r.keep_id, r.group_size) for r in big} == {(7, 203)} and sum(r.kept for r in big) == 1
    assert [r.kept for r in by[hashlib.sha256(b"").hexdigest()]].count(True) == 1
    assert sum(r.kept for r in by[hashlib.sha256(b"x").hexdigest()]) == 1
    light = exact_dedup.exact_dedup(docs, least_copies=10_000)
    assert rows(light) == rows(spark.createDataFrame(out, light.schema))
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    roots = slow_components(prints, 2)
    out = queries.op5_simhash(spark, SF).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in out} == prints
    assert {r.doc_id: r.component_id for r in out} == roots
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in out)


def test_links_in_crowds_and_every_plan(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(64) if rng.random() < 0.3 else 0) for _ in range(400)}
    prints |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    for distance, crowd in ((2, 64), (2, 3), (1, 64), (1, 3)):
        found = {tuple(r) for r in simhash.links(fps, distance, crowd).collect()}
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance for a, b in found)
        roots = {r.node: r.root for r in connected_components(simhash.links(fps, distance, crowd)).collect()}
        wanted = slow_components({signed[p]: p for p in prints}, distance)
        assert {i: roots.get(i, i) for i in wanted} == wanted


def test_thresholds_cover_the_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (100, 10**5, 10**8, 10**10):
        bits = (rng.random((2000, 64)) < 0.5).astype(float)
        bits[:, 1:20] = np.where(rng.random((2000, 19)) < 0.9, bits[:, :1], bits[:, 1:20])
        parts = simhash.plan(bits.T @ bits * (n / 2000), n)
        assert sum(t + 1 for _, t in parts) == 3
        every = [b for own, _ in parts for b in own]
        assert len(every) == len(set(every))


def test_simhash_edges(spark):
    data = [(3, None), (1, ""), (2, " \n"), (None, "a b c d"), (5, "A B C D"), (5, "A B C D"), (6, "one"), (7, "two words"), (8, "w " * 3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "0 as fp", "1 as id")
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert out[(3, "0" * 16)] == out[(2, "0" * 16)] == 1
    assert out[(None, f"{slow_fingerprint('a b c d'):016x}")] == 5
    assert simhash.near_duplicates(docs).count() == len(data)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    pieces = simhash.PIECE
    try:
        simhash.PIECE = 50
        text = "Alpha beta  gamma\tdelta epsilon " * 40
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    finally:
        simhash.PIECE = pieces


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 4)]
    random.Random(2).shuffle(links)
    out = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_sentence_spans_against_brute_force(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    wanted = slow_removed(texts)
    out = {r.doc_id: r for r in queries.op9_sentence_spans(spark, SF).collect()}
    assert {i: r.n_removed for i, r in out.items()} == {i: len(s) for i, s in wanted.items()}
    assert any(wanted.values())
    for i, gone in wanted.items():
        if not gone:
            assert out[i].clean_text == texts[i]


def test_crowded_spans_are_settled_alike(spark, duck, monkeypatch):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    passage = " ".join(f"This line {i} is known to every other one of all the texts here." for i in range(4))
    texts |= {1000 + i: f"Only text {i} says this and nothing but this at its start. {passage} And this is how number {i} ends." for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wanted = {i: len(s) for i, s in slow_removed(texts).items()}
    for least in (2, 30, 10_000):
        monkeypatch.setattr(sentence_spans, "LEAST_COPIES", least)
        assert {r.doc_id: r.n_removed for r in sentence_spans.span_dedup(docs).collect()} == wanted


def test_sentence_spans_planted(spark):
    passage = " ".join(f"Sentence number {i} of the planted passage has {i * 7} words of its own kind here." for i in range(6))
    plain = "The quick fox {0} jumps over. A lazy dog {0} sleeps all day long. Nothing else {0} happens in this little story at all."
    data = [(10, f"{plain.format('ten')} {passage} End of ten."), (11, f"Start of eleven {passage} {plain.format('eleven')}"), (12, plain.format("twelve")), (13, None), (14, ""), (None, "Short."), (15, f"{'x' * 100_000} y.")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 as a", "2 as key", "3 as id")
    out = {r.doc_id: r for r in sentence_spans.span_dedup(docs).collect()}
    assert out[10].clean_text == data[0][1] and out[12].clean_text == data[2][1] and out[13].clean_text is None
    assert "Sentence number 3" not in out[11].clean_text and "lazy dog eleven" in out[11].clean_text
    assert out[14].n_sentences == 0 and out[None].n_removed == 0
    assert sentence_spans.span_dedup(docs.limit(0)).count() == 0
    twice = sentence_spans.span_dedup(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(data) and sum(r.n_removed for r in twice) == 2 * out[11].n_removed


def test_passages_in_the_midst_of_sentences(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passages = [" ".join(word() for _ in range(55)) for _ in range(20)]
    data = [(100 * k + i, " ".join([*(word() for _ in range(rng.randint(1, 30))), p, *(word() for _ in range(rng.randint(1, 30)))])) for i, p in enumerate(passages) for k in (1, 2)]
    out = {r.doc_id: r for r in sentence_spans.span_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    texts = dict(data)
    assert all(out[100 + i].clean_text == texts[100 + i] for i in range(20))
    gone = [len(texts[200 + i].split()) - len(out[200 + i].clean_text.split()) for i in range(20)]
    assert sum(g >= 20 for g in gone) >= 18 and max(gone) <= 55


def test_texts_without_spaces(spark):
    passage = "".join(chr(0x4E00 + i * 37 % 3000) for i in range(60))
    data = [(1, f"{passage[:30]}\u3002{passage[30:]}\u3002"), (2, f"\u524d\u7f6e{passage[:30]}\u3002{passage[30:]}\u3002"), (3, "\u5b8c" * 5)]
    out = {r.doc_id: r for r in sentence_spans.span_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i: r.n_removed for i, r in out.items()} == {i: len(s) for i, s in slow_removed(dict(data)).items()}
    assert out[1].clean_text == data[0][1] and len(out[2].clean_text) < 16 and out[3].clean_text == data[2][1]


def test_many_marked_documents_are_joined_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = rows(sentence_spans.span_dedup(docs))
    monkeypatch.setattr(sentence_spans, "MOST_MARKED", 0)
    assert rows(sentence_spans.span_dedup(docs)) == few


def test_texts_that_repeat_an_id_are_documents_of_their_own(spark, monkeypatch):
    passage = " ".join(f"Sentence number {i} is in both of the texts of this one id." for i in range(6))
    data = [(1, f"{passage} One ends so."), (1, f"Two begins so. {passage}"), (2, f"Three too. {passage}"), (None, passage), (None, f"Again. {passage}")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    few = rows(sentence_spans.span_dedup(docs))
    assert sorted(r.n_removed for r in sentence_spans.span_dedup(docs).collect()) == [0, 6, 6, 6, 6]
    monkeypatch.setattr(sentence_spans, "MOST_REPEATED", 0)
    assert rows(sentence_spans.span_dedup(docs)) == few
