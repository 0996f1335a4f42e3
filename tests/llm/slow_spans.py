"""Repeated sentence spans found by plain loops over texts, for tests."""

import re
import zlib


def slow_sentences(text, window=14):
    """The sentences of a text, each as its words."""
    out, own = [], []
    for line in text.split("\n"):
        words = re.findall("[　-鿿]|[^ \t\r\f\v　-鿿]+", line)
        ends = {i for i, w in enumerate(words) if w[-1] in ".!?。" or (w[-1] in "！？" and re.search("[　-鿿]", text))} | {len(words) - 1}
        cuts = set()
        for a in range(len(words) - window + 1):
            if not any(i in ends for i in range(a, a + window - 1)):
                cuts.add(min(range(a, a + window), key=lambda i: (zlib.crc32(words[i].encode()), -i)))
        for i, w in enumerate(words):
            own.append(w)
            if i in ends or i in cuts:
                out.append(tuple(own))
                own = []
    return out


def slow_spans(sentences, least_words=20, least_sentences=2):
    """(first, last) of the shortest long-enough runs from each sentence, and up to each."""
    enough = lambda a, b: b - a + 1 >= least_sentences and sum(map(len, sentences[a : b + 1])) >= least_words
    n, out = len(sentences), set()
    for i in range(n):
        out |= {(i, b) for b in [next((b for b in range(i, n) if enough(i, b)), None)] if b is not None}
        out |= {(a, i) for a in [next((a for a in range(i, -1, -1) if enough(a, i)), None)] if a is not None}
    return sorted(out)


def slow_removed(texts):
    """The numbers of the sentences that each text loses."""
    seen, out = set(), {}
    for key in sorted(texts):
        own = slow_sentences(texts[key])
        out[key] = set()
        for a, b in slow_spans(own):
            span = tuple(own[a : b + 1])
            if span in seen:
                out[key] |= set(range(a, b + 1))
            seen.add(span)
    return out
