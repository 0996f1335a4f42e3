import random

from quillgrid.llm import sentence_spans


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_no_tail_of_a_copied_text_stays(spark):
    rng = random.Random(3)
    texts = [" ".join(" ".join(words(rng, rng.randint(3, 11))) + "." for _ in range(rng.randint(6, 15))) for _ in range(30)]
    docs = spark.createDataFrame([(100 * k + i, t) for i, t in enumerate(texts) for k in (1, 2)], "doc_id long, text string")
    out = {r.doc_id: r for r in sentence_spans.span_dedup(docs).collect()}
    assert all(out[100 + i].clean_text == t and not out[200 + i].clean_text.strip() for i, t in enumerate(texts))


def test_any_run_of_51_words_shares_a_span():
    rng = random.Random(4)
    for trial in range(3000):
        run = words(rng, 51)
        if trial % 2:
            run = [w + "." if rng.random() < rng.choice([0.02, 0.1]) else w for w in run]
        kinds = []
        for _ in "ab":
            text = " ".join([*words(rng, rng.randint(0, 30)), *run, *words(rng, rng.randint(0, 30))])
            own, ends = sentence_spans.split(text.encode())
            upto = [0, *ends.tolist()]
            kinds.append({tuple(own[upto[a] : upto[b + 1]]) for a, b in zip(*sentence_spans.spans(ends))})
        assert kinds[0] & kinds[1]
