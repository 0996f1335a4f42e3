"""PDF pages as tables: a reader of the file structure and a drawing-state machine, standard library only.

A file is parsed once: its objects, page tree and decoded content streams. Each page's operators are then run
through one state machine (matrices, paths, text positions) that yields rectangles, lines, squares and text
anchors as rows; everything after that is relational.
"""

from __future__ import annotations

import itertools
import re
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.geometry import LEAST_BOX_HEIGHT, LEAST_BOX_WIDTH, LEAST_CHECKBOX, MOST_BOX_HEIGHT, MOST_CHECKBOX, UNDERLINE_HEIGHT
from quillgrid.sources.batches import map_rows

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\{|\}|<[0-9A-Fa-f\s]*>|\(|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+")
#: Tokens of syntax without strings in brackets and comments, a reference as one.
_PLAIN = re.compile(rb"<<|>>|\[|\]|\{|\}|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|\d+\s+\d+\s+R(?![^\s()<>\[\]{}/%])|[^\s()<>\[\]{}/%]+")
_OBJECT_STREAM = re.compile(rb"/(?:O|#4[Ff])(?:b|#62)(?:j|#6[Aa])(?:S|#53)(?:t|#74)(?:m|#6[Dd])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that begins after `(`."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            n = data[at + 1 : at + 2]
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            if n not in (b"\n", b"\r"):
                out += _ESCAPES.get(n, n)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            return bytes(out), at
        out += c
    return bytes(out), at


def _hex(t: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", t[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


@lru_cache(65_536)
def _simple(t: bytes):
    """The value of a token that is a name, keyword, number or reference."""
    if t[:1] == b"/":
        return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), t[1:].decode("latin-1")))
    if t in (b"true", b"false"):
        return t == b"true"
    if t == b"null":
        return None
    if t[-1:] == b"R" and len(n := t.split()) == 3:
        return Ref(n[0])
    try:
        return float(t) if b"." in t else int(t)
    except ValueError:
        return Word(t.decode("latin-1"))


def values(data: bytes, at: int = 0):
    """The values and words of a piece of PDF syntax; containers come whole."""
    stack: list[list] = [[]]
    while m := _TOKEN.search(data, at):
        at, t = m.end(), m[0]
        if t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([])
            continue
        if t in (b">>", b"]") and len(stack) > 1:
            own = stack.pop()
            value = own if t == b"]" else dict(zip(own[::2], own[1::2]))
        elif t == b"(":
            value, at = _string(data, at)
        elif t[:1] == b"<":
            value = _hex(t)
        elif t == b"R" and len(stack[-1]) >= 2 and len(stack) > 1:
            stack[-1].pop()
            value = Ref(stack[-1].pop())
        else:
            value = _simple(t)
        if len(stack) > 1:
            stack[-1].append(value)
            continue
        yield value, at


_SPACES = {b" ", b"\n", b"\r", b"\t", b"\f", b"\v"}
_MARKS = {b"<<", b">>", b"[", b"]", b"R"}


def _plain(data: bytes):
    """(value, whether nothing follows it) of a container without strings in brackets and comments; else None."""
    if b"(" in data or b"%" in data:
        return None
    tokens = _PLAIN.findall(data)
    if not tokens or tokens[0] not in (b"<<", b"["):
        return None
    stack: list[list] = []
    for i, t in enumerate(tokens, 1):
        if t not in _MARKS:
            stack[-1].append(_hex(t) if t[:1] == b"<" else _simple(t))
        elif t == b"<<" or t == b"[":
            stack.append([])
        elif t == b"R":
            number = _simple(t) if len(stack[-1]) < 2 else Ref(stack[-1][-2])
            stack[-1][-2:] = [*stack[-1][-2:], number] if len(stack[-1]) < 2 else [number]
        else:
            own = stack.pop()
            value = own if t == b"]" else dict(zip(own[::2], own[1::2]))
            if not stack:
                return value, i == len(tokens)
            stack[-1].append(value)
    return None


class _Shape:
    """Widgets that differ in numbers, strings and references alone: a pattern of their syntax.

    Names and structure are fixed in the pattern, so whatever it fits has the same tokens. Only a widget of a kind,
    without a parent, whose own entries are written in place has one.
    """

    HOLES = (
        (re.compile(rb"<[0-9A-Fa-f]*>"), rb"<[0-9A-Fa-f]*>"),
        (re.compile(rb"\d+\s+\d+\s+R"), rb"\d+\s+\d+\s+R"),
        (re.compile(rb"-?\d{1,15}(?:\.\d{1,15})?"), rb"-?\d{1,15}(?:\.\d{1,15})?"),
    )

    def __init__(self, data: bytes, entries: dict):
        self.match, self.kind, self.flagged = None, f"/{entries.get('FT')}", "Ff" in entries
        parts, at, depth, place, key, held = [], 0, 0, -1, None, {}
        for m in _PLAIN.finditer(data):
            t = m[0]
            if depth == 1 and place % 2 == 0 and t not in (b">>", b"]"):
                key = t
                if t in held or t[:1] != b"/" or b"#" in t:
                    return
                held[t] = []
            hole = next((made for fits, made in self.HOLES if fits.fullmatch(t)), None)
            parts += re.escape(data[at : m.start()]), hole or re.escape(t)
            if hole and key in (b"/T", b"/Ff", b"/Rect"):
                held[key].append(len(parts) - 1)
            at, depth = m.end(), depth + (t in (b"<<", b"[")) - (t in (b">>", b"]"))
            place += depth == 1
            if t == b"R" or not depth:
                break
        flags = type(entries.get("Ff")) is int and len(held[b"/Ff"]) == 1 or not self.flagged
        rect = isinstance(r := entries.get("Rect"), list) and len(r) == 4 and all(type(v) in (int, float) for v in r) and len(held[b"/Rect"]) == 4
        if not depth and not data[at:].strip() and flags and rect and isinstance(entries.get("T"), bytes) and len(held[b"/T"]) == 1:
            spots = [*held[b"/T"], *held[b"/Rect"], *held.get(b"/Ff", ())]
            for at_ in spots:
                parts[at_] = b"(%s)" % parts[at_]
            self.match = re.compile(b"".join(parts) + re.escape(data[at:]) + b"endobj").match
            self.groups = [sorted(spots).index(at_) + 1 for at_ in spots] + [0] * (not self.flagged)

    def read(self, m: re.Match) -> tuple:
        name, a, b, c, d, flags = m.group(*self.groups)
        return _name(name), self.kind, int(float(flags)) if self.flagged else 0, (float(a), float(b), float(c), float(d))


@lru_cache(65_536)
def _name(digits: bytes) -> str:
    return _text(_hex(digits))


#: The shapes in use, and the widgets of which a worker tries to make one; all others are parsed token by token.
SHAPES, MOST_TRIED = 16, 256
_SHAPES: list[_Shape] = []
_tried = itertools.count()


class File:
    """Objects of a PDF file by number, those in object streams included; each is parsed when it is asked for."""

    def __init__(self, data: bytes):
        self.data, self._held = data, {}
        self._at = dict(self._places())
        if _OBJECT_STREAM.search(data):
            self._unpack()

    def _places(self):
        """(number, place) behind each `number generation obj`."""
        before, *pieces = self.data.split(b"obj")
        at = len(before)
        for piece in pieces:
            at += 3
            if before[-1:] in _SPACES and (not piece or piece[:1] in _SPACES or not (piece[:1].isalnum() or piece[:1] == b"_")):
                head = before.rsplit(None, 2)[-2:]
                if len(head) == 2 and head[1].isdigit() and (piece or at == len(self.data)):
                    number = head[0] if head[0].isdigit() else head[0][len(head[0].rstrip(b"0123456789")) :]
                    if number:
                        yield int(number), at
            at += len(piece)
            before = piece

    def _unpack(self):
        for own in self._at:
            value, stream = self.object(own)
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream is not None:
                body = self._decoded(value, stream)
                first, heads = int(self.get(value.get("First"), 0)), []
                for v, _ in values(body[:first]):
                    heads.append(v)
                for number, offset in zip(heads[::2], heads[1::2]):
                    if number in self._at:
                        continue
                    if value_ := next((v for v, _ in values(b"[" + body[first + offset :])), None):
                        self._held.setdefault(number, (value_, None))
                    else:
                        self._held.setdefault(number, (self._first(body[first + offset :]), None))

    def numbers(self) -> list[int]:
        """All objects' numbers, in the order of the file, those in object streams last."""
        return list(self._at | self._held)

    def object(self, number: int):
        """(value, stream or null) of an object; both null if the file hasn't it."""
        if number not in self._held:
            if number not in self._at:
                return None, None
            self._held[number] = self._object(self._at[number])
        return self._held[number]

    def root(self) -> int | None:
        """The catalog's number."""
        return next((n for n in self.numbers() if isinstance(v := self.object(n)[0], dict) and v.get("Type") == "Catalog"), None)

    def _catalog(self) -> dict:
        return self.object(n)[0] if (n := self.root()) is not None else {}

    def _first(self, data: bytes):
        return next((v for v, _ in values(data)), None)

    def _object(self, at: int):
        stop = self.data.find(b"endobj", at)
        text = self.data[at : stop if stop >= 0 else len(self.data)]
        cut = text.find(b"stream")
        if stop >= 0 and (found := _plain(text if cut < 0 else text[:cut])) and (cut < 0 or found[1]):
            value, end = found[0], cut
            if cut < 0:
                return value, None
        else:
            value, end = next(iter(values(text)), (None, 0))
        if value is None and stop >= 0:  # a string that says endobj
            value, end = next(iter(values(self.data[at:])), (None, 0))
        rest = self.data[at + end : at + end + 20]
        if isinstance(value, dict) and (m := re.match(rb"\s*stream\r?\n", rest)):
            begin = at + end + m.end()
            length = value.get("Length")
            stop = begin + length if type(length) is int and self.data[begin + length : begin + length + 12].lstrip().startswith(b"endstream") else self.data.find(b"endstream", begin)
            return value, self.data[begin:stop]
        return value, None

    def get(self, value, default=None):
        seen: set[int] = set()
        while isinstance(value, Ref) and int(value) not in seen:
            seen.add(int(value))
            value = self.object(int(value))[0]
        value = None if isinstance(value, Ref) else value
        return default if value is None else value

    def _decoded(self, head: dict, stream: bytes) -> bytes:
        filters = self.get(head.get("Filter"), [])
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                return b""
            stream = zlib.decompressobj().decompress(stream)
        return stream

    def stream(self, ref) -> bytes:
        value, stream = self.object(int(ref)) if isinstance(ref, Ref) else (None, None)
        if isinstance(value, list):
            return b"\n".join(self.stream(r) for r in value)
        return self._decoded(value, stream) if stream is not None else b""

    def pages(self):
        """(page dictionary with inherited entries) in order."""
        root = self._catalog()
        seen: set[int] = set()

        def walk(ref, above):
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    return
                seen.add(int(ref))
            node = self.get(ref, {})
            own = above | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"], []):
                    yield from walk(kid, own)
            elif node:
                yield own | node

        yield from walk(root.get("Pages"), {})

    def content(self, page: dict) -> bytes:
        held = page.get("Contents")
        if isinstance(held, list):
            return b"\n".join(self.stream(r) for r in held)
        return self.stream(held) if held is not None else b""

    def size(self, page: dict) -> tuple[float, float]:
        box = [float(self.get(v, 0)) for v in self.get(page.get("MediaBox"), [0, 0, 612, 792])]
        return box[2] - box[0], box[3] - box[1]

    def sizes(self):
        """(page number, width, height) of the pages."""
        return [(i, *self.size(p)) for i, p in enumerate(self.pages(), 1)]

    def packets(self):
        """(index, name, bytes) of the embedded form's packets; a single stream has no name."""
        root = self._catalog()
        held = self.get(root.get("AcroForm"), {}).get("XFA")
        parts = self.get(held)
        if isinstance(parts, list):
            for i in range(0, len(parts) - 1, 2):
                yield i + 1, _text(self.get(parts[i], b"")).strip("/() "), self.stream(parts[i + 1])
        elif isinstance(held, Ref):
            yield 0, None, self.stream(held)

    def fonts(self):
        """(page number, font, default width, first code, last code, width) in thousandths, as ranges."""
        for number, page in enumerate(self.pages(), 1):
            for name, ref in self.get(self.get(page.get("Resources"), {}).get("Font"), {}).items():
                font = self.get(ref, {})
                first = int(self.get(font.get("FirstChar"), 0))
                for i, w in enumerate(self.get(font.get("Widths"), [])):
                    yield number, str(name), 556.0, first + i, first + i, float(self.get(w, 0))
                for d in self.get(font.get("DescendantFonts"), [])[:1]:
                    own = self.get(d, {})
                    default, ws, i = float(self.get(own.get("DW"), 1000)), self.get(own.get("W"), []), 0
                    while i + 1 < len(ws):
                        a, b = int(self.get(ws[i], 0)), self.get(ws[i + 1], 0)
                        if isinstance(b, list):
                            for k, w in enumerate(b):
                                yield number, str(name), default, a + k, a + k, float(self.get(w, 0))
                            i += 2
                        elif i + 2 < len(ws):
                            yield number, str(name), default, a, int(b), float(self.get(ws[i + 2], 0))
                            i += 3
                        else:
                            break

    def _shaped(self, ref):
        """(name, kind, flags, rectangle) of a widget of a shape that was met."""
        if isinstance(ref, Ref) and (at := self._at.get(ref)) is not None and ref not in self._held:
            for shape in _SHAPES:
                if m := shape.match(self.data, at):
                    return shape.read(m)
        return None

    def _learn(self, ref, widget):
        at = self._at.get(ref) if isinstance(ref, Ref) else None
        if at is None or not isinstance(widget, dict) or not 0 < (stop := self.data.find(b"endobj", at)) - at < 2_000:
            return
        text = self.data[at:stop]
        if b"(" in text or b"%" in text or widget.get("Subtype") != "Widget" or "Parent" in widget or not isinstance(widget.get("FT"), Name):
            return
        if next(_tried) < MOST_TRIED and (shape := _Shape(text, widget)).match is not None:
            _SHAPES[SHAPES - 1 :] = [shape]

    def widgets(self):
        """(page number, full field name, kind, flags, rectangle) of the pages' form widgets."""
        for number, page in enumerate(self.pages(), 1):
            for ref in self.get(page.get("Annots"), []):
                if shaped := self._shaped(ref):
                    yield number, *shaped
                    continue
                widget = self.get(ref, {})
                self._learn(ref, widget)
                if widget.get("Subtype") != "Widget":
                    continue
                node, names, kind, flags, seen = widget, [], None, None, set()
                while node and id(node) not in seen:
                    seen.add(id(node))
                    if "T" in node:
                        names.append(_text(self.get(node["T"], b"")))
                    kind = kind or self.get(node.get("FT"))
                    flags = self.get(node.get("Ff")) if flags is None else flags
                    node = self.get(node.get("Parent"), {})
                rect = [float(self.get(v, 0)) for v in self.get(widget.get("Rect"), [0, 0, 0, 0])]
                yield number, ".".join(reversed(names)), f"/{kind}" if kind else None, int(flags or 0), rect


def _text(data) -> str:
    if not isinstance(data, bytes):
        return str(data)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def drawn(content: bytes):
    """(kind, x, y, w, h, text) of a content stream: rect, line, checkbox and anchor rows.

    Rectangles and paths follow the graphics matrix; text positions follow the text matrix and line moves
    alone. A rectangle is an input by its size, a checkbox if small and square; a straight line wide enough is
    an underline of fixed height, a closed path of four corners a checkbox. White fills draw nothing.
    """
    identity = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    matrix, saved, operands = identity, [], []
    rects, path, white = [], [], False
    line = place = (0.0, 0.0)
    for value, _ in values(content):
        if not isinstance(value, Word):
            operands.append(value)
            continue
        try:
            n = [float(v) for v in operands if isinstance(v, int | float) and not isinstance(v, bool)]
            op = str(value)
            if op == "q":
                saved.append((matrix, white))
            elif op == "Q" and saved:
                matrix, white = saved.pop()
            elif op == "cm":
                matrix = _times(tuple(n[:6]), matrix)
            elif op in ("g", "rg", "k"):
                white = n == [1.0] or n == [1.0, 1.0, 1.0] if op != "k" else n == [0.0] * 4
            elif op == "re":
                x, y, w, h = n[:4]
                corners = [_times((1, 0, 0, 1, cx, cy), matrix)[4:] for cx in (x, x + w) for cy in (y, y + h)]
                xs, ys = [c[0] for c in corners], [c[1] for c in corners]
                rects.append((min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)))
            elif op in ("m", "l"):
                if op == "m":
                    path = []
                path.append(_times((1, 0, 0, 1, n[0], n[1]), matrix)[4:])
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                filled = op[0] in "fF"
                if not (filled and white) and op != "n":
                    yield from _shapes(rects, path)
                rects, path = [], []
            elif op == "BT":
                line = place = (0.0, 0.0)
            elif op == "Tm":
                line = place = (n[4], n[5])
            elif op in ("Td", "TD"):
                line = place = (line[0] + n[0], line[1] + n[1])
            elif op in ("Tj", "TJ"):
                held = operands[-1] if operands else b""
                parts = held if isinstance(held, list) else [held]
                text = b"".join(p for p in parts if isinstance(p, bytes)).decode("latin-1").strip()
                if text:
                    yield "anchor", place[0], place[1], 0.0, 0.0, text
        except (IndexError, TypeError):
            pass  # an operator without its operands draws nothing
        operands = []


def _shapes(rects, path):
    for x, y, w, h in rects:
        if LEAST_CHECKBOX <= w <= MOST_CHECKBOX and LEAST_CHECKBOX <= h <= MOST_CHECKBOX and abs(w - h) / max(w, h) < 0.3:
            yield "checkbox", round(x, 1), round(y, 1), round(w, 1), round(h, 1), None
        elif w >= LEAST_BOX_WIDTH and LEAST_BOX_HEIGHT <= h <= MOST_BOX_HEIGHT:
            yield "rect", round(x, 1), round(y, 1), round(w, 1), round(h, 1), None
    if len(path) == 2 and abs(path[0][1] - path[1][1]) <= 1 and abs(path[0][0] - path[1][0]) >= LEAST_BOX_WIDTH:
        (ax, ay), (bx, by) = path
        yield "line", round(min(ax, bx), 1), round((ay + by) / 2, 1), round(abs(ax - bx), 1), UNDERLINE_HEIGHT, None
    elif len(path) >= 4:
        xs, ys = [p[0] for p in path], [p[1] for p in path]
        x, y, w, h = min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)
        corners = {(round(a, 1), round(b, 1)) for a in (x, x + w) for b in (y, y + h)}
        if LEAST_CHECKBOX <= w <= MOST_CHECKBOX and LEAST_CHECKBOX <= h <= MOST_CHECKBOX and abs(w - h) / max(w, h) < 0.3 and corners <= {(round(a, 1), round(b, 1)) for a, b in path}:
            yield "checkbox", round(x, 1), round(y, 1), round(w, 1), round(h, 1), None


def _tables(found: DataFrame, rows, columns: str) -> DataFrame:
    def parse(path, content):
        if content[:4] == b"%PDF":
            yield from ((path, *r) for r in rows(File(content)))

    return map_rows(found.select("path", "content"), parse, columns)


def page_sizes(found: DataFrame) -> DataFrame:
    """(path, page, width, height) of PDF files (path, content); other files have no rows."""
    return _tables(found, File.sizes, "path string, page int, width double, height double")


def page_lists(found: DataFrame) -> DataFrame:
    """As page_sizes, and one row without a page for each file that has none or is no PDF file."""

    def parse(path, content):
        sizes = File(content).sizes() if content[:4] == b"%PDF" else ()
        yield from ((path, *r) for r in sizes or [(None, None, None)])

    return map_rows(found.select("path", "content"), parse, "path string, page int, width double, height double")


def drawn_items(found: DataFrame) -> DataFrame:
    """(path, page, seq, kind, x, y, w, h, text) of all pages."""

    def rows(f: File):
        return [(i, k, *item) for i, p in enumerate(f.pages(), 1) for k, item in enumerate(drawn(f.content(p)))]

    return _tables(found, rows, "path string, page int, seq int, kind string, x double, y double, w double, h double, text string")


#: Kinds of widgets begin with a slash.
PAGE = "page"
_WIDGETS = "page int, name string, ft string, ff int, x double, y double, w double, h double"


def _widget_rows(f: File):
    return ((i, name, kind, flags, r[0], r[1], r[2] - r[0], r[3] - r[1]) for i, name, kind, flags, r in f.widgets())


def widgets(found: DataFrame) -> DataFrame:
    """(path, page, name, ft, ff, x, y, w, h) of form widgets, names with their parents' before them."""

    return _tables(found, _widget_rows, f"path string, {_WIDGETS}")


def pages_and_widgets(found: DataFrame) -> DataFrame:
    """The widgets as widgets() has them and the pages, of kind PAGE and without a name; files are read once."""

    def rows(f: File):
        pages = ((page, None, PAGE, 0, 0.0, 0.0, width, height) for page, width, height in f.sizes())
        return itertools.chain(pages, _widget_rows(f))

    return _tables(found, rows, f"path string, {_WIDGETS}")


def form_packets(found: DataFrame) -> DataFrame:
    """(path, seq, name, xml) of PDF files' embedded form packets."""
    return _tables(found, lambda f: [(i, n, d.decode("utf-8", "replace")) for i, n, d in f.packets()], "path string, seq int, name string, xml string")


def template_packet(packets: DataFrame) -> DataFrame:
    """(path, seq, name, xml): a file's whole form, else its template packet, else the first named xdp or form."""
    rank = F.when(F.col("name").isNull(), 0).when(F.col("name") == "template", 1).when(F.col("name").isin("xdp", "form"), 2)
    ranked = packets.withColumn("rank", rank).where("rank is not null")
    best = ranked.groupBy("path").agg(F.min(F.struct("rank", "seq", "name", "xml")).alias("b"))
    return best.select("path", "b.seq", F.col("b.name").alias("name"), "b.xml")


def font_widths(found: DataFrame) -> DataFrame:
    """(path, page, font, default_em, code, em): widths of codes in ems, ranges expanded."""
    ranges = _tables(found, lambda f: list(f.fonts()), "path string, page int, font string, default_width double, first int, last int, width double")
    code = F.explode(F.expr("if(last >= first, sequence(first, last), array())"))
    return ranges.select("path", "page", "font", (F.col("default_width") / 1000).alias("default_em"), code.alias("code"), (F.col("width") / 1000).alias("em"))


def advances(units: DataFrame, widths: DataFrame) -> DataFrame:
    """(id, em): the summed advance of a run's units (id, path, page, font, code); unknown codes have the default."""
    keys = ["path", "page", "font"]
    defaults = widths.groupBy(*keys).agg(F.max("default_em").alias("default_em"))
    joined = units.join(widths.drop("default_em"), [*keys, "code"], "left").join(defaults, keys, "left")
    return joined.groupBy("id").agg(F.sum(F.coalesce("em", "default_em", F.lit(0.556))).alias("em"))


def cid_units(text: Column) -> Column:
    """a binary column as big-endian two-byte units, or null: 20 bytes or more, an even number, and half of
    the high bytes zero."""
    digits = F.hex(text)
    count = (F.length(text) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(digits, i * 4 + 1, F.lit(4)))
    zero = F.size(F.filter(pairs, lambda p: p.startswith("00")))
    fits = (F.length(text) >= 20) & (F.length(text) % 2 == 0) & (zero * 2 >= count)
    return F.when(fits, F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int")))
