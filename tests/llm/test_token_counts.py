import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgrid.llm import token_counts
from quillgrid.llm.token_counts import Counter

TEXTS = [
    "", " ", "a  b", "\n\n", "x" * 3000, "日本語テキスト" * 200, "don't stop'll \t\r\n ok " * 100, "é ́ à " * 200, "İ ß Ǆ ﬁ 12 345 " * 150,
    "<|endoftext|> x<|startoftext|>y " * 60, "<|EndOfText|> <|endoftext |> ", "a b c \x1c d\x85e " * 80, "word " * 4000 + "y" * 2500 + " tail" * 900,
]


def whole(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (300, 16), (90, 4)])
def test_spliced_counts_equal_whole_encodings(file, chunk, overlap):
    path = public_tokenizers.path(file)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab ' \n\t1é日́<|>İ. ") for _ in range(rng.randint(1, 1500))) for _ in range(40)]
    counter = Counter(path, chunk, overlap)
    assert counter.count(texts) == [whole(path)(t) for t in texts]


def test_overlaps_are_widened_where_no_boundary_is():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = Counter(path, 100, 8)
    text = "z" * 700 + " a b c " * 50
    assert counter.spliced(text) == whole(path)(text)
    assert counter.widened > 0


def test_sentencepiece():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    wanted = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) for t in TEXTS]
    assert Counter(path).count(TEXTS) == wanted


def test_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    data = [(1, "héllo world", "x"), (1, "héllo world", "x"), (None, None, "y"), (2, "", None), (3, "a " * 3000, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens string")
    out = token_counts.token_counts(docs, path)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(1, 12, whole(path)("héllo world"), False)] * 2 + [(None, 0, 0, False), (2, 0, 0, False), (3, 6000, 3000, True)], key=repr)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
