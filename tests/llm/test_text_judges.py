import hashlib
import re
import zlib

import numpy as np
from conftest import SF, duck_rows, rows

from quillgrid.llm import chat, decontaminate, language_id, queries, url_filter


def test_decontamination_equals_sql(spark, duck):
    columns, wanted = duck_rows(duck, decontaminate.SQL)
    out = queries.op4_decontamination(spark, SF)
    assert sorted(out.columns) == columns and rows(out) == wanted


def slow_hits(text, items, window):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, met = words(text), set(), set()
    for item, body in items:
        w = words(body)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(own) - m + 1):
                if own[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    met.add(item)
    return len(own), len(hit), met


def test_automaton_against_brute_force():
    import random

    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "c", "É", "d1"])
    for _ in range(60):
        items = [(f"i{k}", " ".join(word() for _ in range(rng.randint(0, 9)))) for k in range(rng.randint(0, 6))]
        find = decontaminate.Matcher([(k, t.encode()) for k, t in items], 4)
        text = ", ".join(word() for _ in range(rng.randint(0, 40)))
        n, spans, met, _ = find.stream(text.encode())
        assert (n, sum(b - a for a, b in spans), met) == slow_hits(text, items, 4)
    pieces, blocks = decontaminate.PIECE, decontaminate.BLOCK_BYTES
    try:
        decontaminate.PIECE, decontaminate.BLOCK_BYTES = 7, 10
        find = decontaminate.Matcher([(k, t.encode()) for k, t in items], 4)
        assert find.stream(text.encode())[:3] == (n, spans, met)
    finally:
        decontaminate.PIECE, decontaminate.BLOCK_BYTES = pieces, blocks


def test_removal_and_edges(spark):
    item = "the rain in spain stays mainly in the plain every other monday"
    data = [(1, f"Before words here are long enough to stay, yes they are. {item.title()}! After all of that.", "x", 5), (2, item, "x", 5), (3, None, None, None), (4, "", "x", 0), (None, "clean", "x", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "!!")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.remove_contamination(docs, benchmark, length_col="n_chars").collect()}
    assert set(out) == {1, 3, 4, None} and out[1].text == "Before words here are long enough to stay, yes they are. ! After all of that."
    assert out[1].n_chars == len(out[1].text) and out[None].n_chars == 5 and out[3].text is None
    judged = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert (judged[2].n_words, judged[2].n_hit, judged[2].n_items) == (12, 12, 1)
    assert judged[2].items_sha256 == hashlib.sha256(b"7").hexdigest() and judged[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_language_accuracy_on_held_out_documents(spark, duck):
    langs = dict(duck.sql("select doc_id, lang from documents").fetchall())
    out = queries.op3_language_id(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in out} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in langs}
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred in set(langs.values()) for r in out)


def test_gradients_are_right():
    net = language_id.Network(["a", "b"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = language_id._padded([b"ab cd", b"c"])
    y, w = np.array([0, 1]), language_id._LETTER[x]
    _, g = net.gradients(x, y, w)
    for name, at in (("xf", (2, 97)), ("xf", (7, 98)), ("hf", (4, 1)), ("hb", (8, 2)), ("hb", (0, 0)), ("xb", (0, 99)), ("o", (1, 3)), ("c", (0, 0))):
        old, eps = net.p[name][at], 1e-4
        net.p[name][at] = old + eps
        up = net.gradients(x, y, w)[0]
        net.p[name][at] = old - eps
        down = net.gradients(x, y, w)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-6


def test_labels_do_not_depend_on_the_batch():
    net = language_id.Network(["a", "b", "c"], seed=3)
    texts = [b"a", b"tion", b"an uncommonly long text" * 40, "\u00e9t\u00e9 ".encode() * 90]
    together = net.predict(texts)
    for text, (label, score) in zip(texts, together):
        (alone,) = net.predict([text])
        assert alone[0] == label and abs(alone[1] - score) < 1e-5


def slow_scores(net, data):
    """Mean label distribution over a text's letters, a byte and a number at a time."""
    soft = lambda v: v / (1 + abs(v))
    k, p = net.hidden, {name: v.tolist() for name, v in net.p.items()}

    def states(own, side):
        h, out = [0.0] * k, []
        for byte in own if side == "f" else reversed(own):
            a = [row[byte] for row in p[f"x{side}"]]
            b = [sum(w * v for w, v in zip(row, h)) for row in p[f"h{side}"]]
            r = [0.5 + 0.5 * soft(a[i] + b[i]) for i in range(k)]
            z = [0.5 + 0.5 * soft(a[i] + b[i]) for i in range(k, 2 * k)]
            c = [soft(a[2 * k + i] + r[i] * b[2 * k + i]) for i in range(k)]
            h = [z[i] * h[i] + (1 - z[i]) * c[i] for i in range(k)]
            out.append(h)
        return out if side == "f" else out[::-1]

    total, n, at = [0.0] * len(net.labels), 0, 0
    pieces = -(-len(data) // language_id.SEGMENT)
    back = lambda i: i if not 0 < i < len(data) or data[i] & 0xC0 != 0x80 else back(i - 1)
    for piece in range(pieces):
        begin, end = back(piece * len(data) // pieces), back((piece + 1) * len(data) // pieces)
        assert begin == at
        at = end
        left, right = back(max(0, begin - 32)), back(min(len(data), end + 32))
        own = data[left:right]
        for i, (f, b) in enumerate(zip(states(own, "f"), states(own, "b"))):
            byte = own[i]
            if begin <= left + i < end and (chr(byte).isalpha() and byte < 128 or byte >= 128):
                scores = [sum(w * v for w, v in zip(row, f + b)) + c[0] for row, c in zip(p["o"], p["c"])]
                top = [np.exp(v - max(scores)) for v in scores]
                total = [t + v / sum(top) for t, v in zip(total, top)]
                n += 1
    return [t / n for t in total]


def test_whole_texts_against_a_slow_network(duck):
    net = language_id.Network(["a", "b", "c"], seed=5)
    texts = [t.encode() for (t,) in duck.sql("select text from documents where len(text) between 1 and 1500 order by doc_id limit 12").fetchall()]
    texts += ["\u00e9\u4e2d\u6587 \U0001f600".encode() * 60, b"x"]
    for text, (label, score) in zip(texts, net.predict(texts)):
        wanted = slow_scores(net, text)
        assert label == net.labels[int(np.argmax(wanted))] and abs(score - max(wanted)) < 1e-4


def test_a_rare_language_is_learned(spark):
    import random

    rng = random.Random(2)
    text = lambda words: " ".join(rng.choice(words) for _ in range(40))
    known = {"x": ["the", "of", "and", "water"], "y": ["der", "und", "wasser", "nicht"], "z": ["kyo", "zuku", "wazo", "yoku"]}
    data = [(i, text(known[lang]), lang) for i, lang in enumerate(["x"] * 1500 + ["y"] * 1500 + ["z"] * 12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = language_id.train(docs, sample_docs=200)
    assert net.labels == ["x", "y", "z"]
    assert [net.predict([text(known[lang]).encode()])[0][0] for lang in "xyz"] == ["x", "y", "z"]
    kept = language_id.keep_identified(docs, net)
    assert kept.count() >= 0.99 * len(data) and language_id.keep_identified(docs, net, least=1.01).count() == 0


def test_language_edges(spark):
    data = [(i, "the cat and the dog " * 3, "en") for i in range(40)] + [(100 + i, "der Hund und die Katze " * 3, "de") for i in range(40)]
    data += [(500, None, "en"), (501, "", None), (502, "123 !!", "en"), (None, "the dog", None), (503, "z" * 5000, None), (504, "日本", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as id")
    net = language_id.train(docs)
    out = {r.doc_id: r for r in language_id.identify(docs, net).collect()}
    assert [out[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and out[None].lang_pred == "en" and out[None].held_out
    assert out[503].lang_pred in ("en", "de") and out[504].lang_pred in ("en", "de")
    assert {out[i].lang_pred for i in range(40)} == {"en"} and {out[100 + i].lang_pred for i in range(40)} == {"de"}
    kept = language_id.keep_identified(docs, net)
    assert kept.columns == docs.columns
    wanted = {i for i, r in out.items() if r.lang_pred != "und" and r.score >= net.least}
    assert {r.doc_id for r in kept.collect()} == wanted and wanted >= {i for i, _, lang in data[:80]} | {None}
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), net).count() == 0


def read(turns, control="<|im_end|>"):
    digest, learned, size = hashlib.sha256(), "", 0
    for role, text in turns:
        role, text = role or "", text or ""
        digest.update(f"{role}\n{text}\n".encode())
        learned += text if role == "assistant" else ""
    return len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_conversations_read_back(spark, duck):
    convs = {}
    for conv, role, text in duck.sql("select conv_id, role, text from conversations order by conv_id, turn").fetchall():
        convs.setdefault(conv, []).append((role, text))
    tricky = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [("user", tricky), ("assistant", tricky)]
    out = queries.op7_chat_format(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == {k: read(v) for k, v in convs.items()}
    plain = {k: sum(len(f"<|im_start|>{r}\n{t}<|im_end|>\n") for r, t in v) for k, v in convs.items()}
    assert {r.conv_id: r.formatted_chars for r in out if r.conv_id >= 0} == {k: n for k, n in plain.items() if k >= 0}


def test_conversations_equal_sql(spark, duck):
    columns, wanted = duck_rows(duck, chat.SQL)
    out = queries.op7_chat_format(spark, SF)
    assert sorted(out.columns) == columns and rows(out) == wanted


def test_escaping_is_reversible():
    for text in ("", "<|", "<\\|", "<\\\\|x<|im_end|>", "<", "|", "\\", "<<||>>", "a\nb", "<|im_start|>user\nhi<|im_end|>\n"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_edges(spark):
    data = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "user", "lost?"), (2, 5, "as<|sistant\nx", "<|im_end|>")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as node")
    out = {r.conv: r for r in chat.read_back(chat.format_trees(chat.from_turns(turns))).collect()}
    assert (out[1].n_turns, out[1].turns_sha256) == read([("assistant", "first"), ("user", None), (None, "x"), (None, "x")])[:2]
    assert out[None].n_turns == 1 and out[2].turns_sha256 == read([("as<|sistant\nx", "<|im_end|>")])[1]
    assert chat.read_back(chat.format_trees(chat.from_turns(turns.limit(0)))).count() == 0


def test_paths_of_a_tree(spark):
    #        1 -> 2 -> 4 (best), 2 -> 5;  1 -> 3;  lone root 9 of another conversation; 7 <-> 8 is no tree
    data = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 0.2), (1, 4, 2, 5.0), (1, 5, 2, 0.0), (2, 9, None, None), (3, 7, 8, 1.0), (3, 8, 7, 1.0), (4, 6, 77, 1.0)]
    nodes = spark.createDataFrame(data, "conv long, node long, parent long, score double")
    out = {}
    for r in chat.paths(nodes, 2).collect():
        out.setdefault((r.conv, r.path), {})[r.pos] = r.node
    assert out == {(1, 0): {0: 1, 1: 2, 2: 4}, (1, 1): {0: 1, 1: 2, 2: 5}, (2, 0): {0: 9}}


def slow_rule(host, path):
    found = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found, default=(0, None, None))[1:]


def test_url_filter(spark, duck):
    pages = dict(duck.sql("select page_id, url from pages").fetchall())
    out = {r.page_id: r for r in queries.op10_url_filter(spark, SF).collect()}
    assert out.keys() == pages.keys()
    for i, url in pages.items():
        host, path = (b.decode() for b in url_filter.split_url(url))
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, slow_rule(host, path)[0])
        assert out[i].verdict in ("allow", "block") and (out[i].rule is None or out[i].verdict == slow_rule(host, path)[1])


def test_url_edges_and_model(spark):
    urls = [None, "", "nothing", "://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://x.com", "http://h?u/", "x://a/b://c", "http://casino-royal.org/", "http://library.org/books", "http://é.org/ü"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.com/", "h")], "page_id long, url string, host string").selectExpr("*", "1 as score", "2 as action")
    out = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [(out[i].host, out[i].path) for i in range(4)] == [("", "")] * 4
    assert (out[4].host, out[4].path, out[4].rule, out[4].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert [(out[i].rule, out[i].verdict) for i in (5, 6, 7)] == [("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block")]
    assert out[8].rule is None and (out[9].host, out[9].path) == ("h", "") and (out[10].host, out[10].path) == ("a", "/b://c")
    assert out[11].verdict == "block" and out[12].verdict == "allow" and out[None].verdict == "allow"
    for i, u in enumerate(urls):
        assert (out[i].host.encode(), out[i].path.encode()) == url_filter.split_url(u)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


#: Written apart from the labelled table, with hosts that it doesn't hold.
HELD_OUT_BLOCKED = "http://bestcasinobonus.net/ https://www.pokerstrategy-club.com/ http://free-bets.example.com/en/27 http://www.cheap-pills.example.com/de/1 http://hot-sex-videos.com/watch https://online-slots-jackpot.org/ http://pornclips.net/ http://fastpaydayloan.com/apply http://viagrapills.net/ https://nudecamgirls.tv/live http://gambling-casino.info http://spam-farm.example.com/de/4"
HELD_OUT_ALLOWED = "http://essexcricket.org/ http://betterbread.com/ http://pillowtalk-magazine.com/issue https://history.stateuniversity.edu/ http://www.ththan.example.net/de/50 http://blog.tiontion.example.com/en/3 http://weathermaps.net/ https://musicschool.org/courses http://museum.gov/visit http://windowfarm.org/ http://camping-guide.net/ http://alphabet-books.com/kids http://m.theror.example.com/en/210"


def test_url_model_on_held_out_urls(spark):
    known = {url_filter.split_url(u)[0] for u, _ in url_filter.labelled_table()}
    held = [(u, "block") for u in HELD_OUT_BLOCKED.split()] + [(u, "allow") for u in HELD_OUT_ALLOWED.split()]
    assert not known & {url_filter.split_url(u)[0] for u, _ in held} - {b"history.stateuniversity.edu"}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    out = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules=()).collect()}
    assert np.mean([out[i] == verdict for i, (_, verdict) in enumerate(held)]) >= 0.92
    weights, bias = url_filter.built_in_model()
    for r in url_filter.filter_urls(pages, rules=()).collect():  # the score is the regression's, n-gram by n-gram
        whole = b"\x02" + r.host.encode() + b"\x03" + r.path.encode() + b"\x04"
        grams, cells = 0, []
        for n in url_filter.SIZES:
            for i in range(len(whole) - n + 1):
                h = n
                for c in whole[i : i + n]:
                    h = (h * 1_000_003 ^ c) % 2**64
                h = (h * 2 + (i >= len(r.host.encode()) + 2)) * 0x9E3779B97F4A7C15 % 2**64
                cells.append((h >> 40) % url_filter.DIMENSIONS)
                grams += 1
        z = sum(weights[c] for c in cells) / max(1, grams) ** 0.5 + bias
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5


def test_many_rules_are_joined_alike(spark, monkeypatch):
    import random

    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "net", "x-y"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/en", "/en/", "q"]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(120))}.values())
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#t'])}" for _ in range(1500)] + [None, "", "://", "nothing"] + ["http://a.com/en/"] * 1200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    plain = rows(url_filter.filter_urls(pages, rules))
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    assert rows(url_filter.filter_urls(pages, rules)) == plain
    assert any(r[3] is not None for r in plain)


def test_many_parts_of_test_items_are_merged(spark, monkeypatch):
    import random

    rng = random.Random(12)
    word = lambda: rng.choice("abcdefg") * rng.randint(1, 2)
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 16)))) for k in range(30)]
    data = [(i, " ".join([*(word() for _ in range(20)), rng.choice(items)[1], *(word() for _ in range(20)), rng.choice(items)[1]]), "x", 3, "w") for i in range(40)]
    data += [(None, None, "x", 3, "w"), (50, "", "x", 0, "w")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, words string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    judge = lambda: sorted(map(repr, decontaminate.contamination(docs, benchmark).collect()))
    clean = lambda: sorted(map(repr, decontaminate.remove_contamination(docs, benchmark, drop_coverage=0.9, length_col="n_chars").collect()))
    whole, left = judge(), clean()
    assert any("contaminated=True" in r for r in whole)
    monkeypatch.setattr(decontaminate, "PART_BYTES", 150)
    assert judge() == whole
    assert clean() == left
