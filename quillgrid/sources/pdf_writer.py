"""K6: fillable PDF files from flat ones and field specs, standard library only.

A file is read into objects, widgets and a field tree are added, and all objects are written anew with a fresh
cross-reference table. Encrypted files are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.widgets import MULTILINE, PUSH_BUTTON
from quillgrid.sources.batches import map_groups
from quillgrid.sources.pdf import File, Name, Ref, Word


class Raw(bytes):
    """A value, or an object with its stream, that is in PDF syntax already."""


@lru_cache(4096)
def _name(name: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and chr(c) not in "#()<>[]{}/%" else b"#%02X" % c for c in name.encode("latin-1", "replace"))


@lru_cache(65_536)
def _number(value: float) -> bytes:
    return b"%d" % value if value.is_integer() else f"{value:.6f}".rstrip("0").rstrip(".").encode()


def serialised(value) -> bytes:
    """A value in PDF syntax."""
    if isinstance(value, Raw):
        return value
    if isinstance(value, Ref):
        return b"%d 0 R" % value
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Name):
        return _name(str(value))
    if isinstance(value, Word):
        return str(value).encode("latin-1")
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, dict):
        return b"<< " + b" ".join(serialised(Name(k)) + b" " + serialised(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialised, value)) + b"]"
    return _number(value) if isinstance(value, float) else str(value).encode()


@lru_cache(65_536)
def _string(text: str) -> bytes:
    return serialised(text.encode("ascii") if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be"))


@lru_cache(4096)
def _appearances(w: float, h: float) -> tuple[Raw, Raw]:
    """The objects that draw a checkbox, off and on."""
    cross = f"q 1 w 2 2 m {w - 2:.2f} {h - 2:.2f} l 2 {h - 2:.2f} m {w - 2:.2f} 2 l S Q".encode()
    head = b"<< /Type /XObject /Subtype /Form /BBox [0 0 %s %s] /Resources <<  >> /Length %d >>\nstream\n%s\nendstream"
    return Raw(head % (_number(w), _number(h), 0, b"")), Raw(head % (_number(w), _number(h), len(cross), cross))


_WIDGET = b"<< /Type /Annot /Subtype /Widget /T %s /Rect [%s %s %s %s] /F 4 /P %d 0 R "
_CHECKBOX = _WIDGET + b"/FT /Btn /Ff 0 /V /%s /AS /%s /AP << /N << /Off %d 0 R /Yes %d 0 R >> >> >>"
_IMAGE = _WIDGET + b"/FT /Btn /Ff %d /H /P /Border [0 0 1] /BS << /W 1 /S /B >> /MK << /BG [0.75] /TP 1 >> >>"
_TEXT = _WIDGET + b"/FT /Tx /Ff %d /DA <2f48656c7620313020546620302067> /V %s /Border [0 0 0] >>"


class Builder:
    def __init__(self, data: bytes, file: File | None = None):
        self.file = file or File(data)
        if b"/Encrypt" in data:
            raise ValueError("encrypted files aren't built on")
        held = ((k, self.file.object(k)) for k in self.file.numbers())
        self.objects = {k: v for k, v in held if not (isinstance(v[0], dict) and v[0].get("Type") in ("ObjStm", "XRef"))}
        self.last = max(self.objects, default=0)

    def add(self, value, stream: bytes | None = None) -> Ref:
        self.last += 1
        self.objects[self.last] = (value, stream)
        return Ref(self.last)

    def widget(self, page: int, name: str, kind: str, x: float, y: float, w: float, h: float, value: str | None = None) -> Ref:
        x, y, w, h = float(x), float(y), float(w), float(h)
        own = _string(name), _number(x), _number(y), _number(x + w), _number(y + h), page
        value = value or ""
        if kind == "checkbox":
            state = b"Yes" if value.strip().lower() in ("1", "true", "yes", "on", "checked", "v") else b"Off"
            off, on = map(self.add, _appearances(w, h))
            return self.add(Raw(_CHECKBOX % (*own, state, state, off, on)))
        if kind == "image":
            return self.add(Raw(_IMAGE % (*own, PUSH_BUTTON)))
        return self.add(Raw(_TEXT % (*own, MULTILINE if kind == "textarea" else 0, _string(value))))

    def build(self, specs: list[dict]) -> bytes:
        return self.built((s["page"], s["name"], s["type"], s["x"], s["y"], s["w"], s["h"], s.get("value")) for s in specs)

    def built(self, specs: Iterable[tuple]) -> bytes:
        """The file with a widget for each (page, name, type, x, y, w, h, value)."""
        root = next((k for k, (v, _) in self.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("the file has no catalog")
        numbers = [int(r) for r in self._page_refs(self.objects[root][0].get("Pages"), set())]
        fields, own = [], {}
        for page, name, kind, x, y, w, h, value in specs:
            if not 1 <= page <= len(numbers):
                raise ValueError(f"{name} is on page {page} of {len(numbers)}")
            number = numbers[page - 1]
            ref = self.widget(number, name, kind, x, y, w, h, value)
            own.setdefault(number, []).append(ref)
            fields.append(ref)
        for number, refs in own.items():
            page, stream = self.objects[number]
            self.objects[number] = (page | {"Annots": [*self.file.get(page.get("Annots"), []), *refs]}, stream)
        font = self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")})
        form = {"Fields": fields, "NeedAppearances": True, "DR": {"Font": {"Helv": font}}, "DA": b"/Helv 10 Tf 0 g"}
        self.objects[root] = (self.objects[root][0] | {"AcroForm": form}, None)
        return self.written(root)

    def _page_refs(self, ref, seen: set[int]):
        if not isinstance(ref, Ref) or int(ref) in seen:
            return
        seen.add(int(ref))
        node = self.file.get(ref, {})
        if "Kids" in node:
            for kid in self.file.get(node["Kids"], []):
                yield from self._page_refs(kid, seen)
        elif node:
            yield ref

    def written(self, root: int) -> bytes:
        out, places, at = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], {}, 15
        for number in sorted(self.objects):
            value, stream = self.objects[number]
            if stream is not None:
                value = {**value, "Length": len(stream)}
            own = b"%d 0 obj\n%s\n" % (number, serialised(value))
            if stream is not None:
                own += b"stream\n" + stream + b"\nendstream\n"
            places[number] = at
            out.append(own + b"endobj\n")
            at += len(own) + 7
        top = max(places) + 1
        out.append(b"xref\n0 %d\n0000000000 65535 f \n" % top)
        out += [b"%010d 00000 n \n" % places[number] if number in places else b"0000000000 65535 f \n" for number in range(1, top)]
        out.append(b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (top, root, at))
        return b"".join(out)


def without_form(data: bytes) -> bytes:
    """A file without its embedded form packets; viewers are told to draw the fields."""
    builder = Builder(data)
    root = next(k for k, (v, _) in builder.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog")
    catalog = builder.objects[root][0]
    form = {k: v for k, v in builder.file.get(catalog.get("AcroForm"), {}).items() if k != "XFA"}
    builder.objects[root] = (catalog | {"AcroForm": form | {"NeedAppearances": True}}, None)
    return builder.written(root)


def with_template(data: bytes, xml: bytes) -> bytes:
    """K8: a file with the template as its only form packet; its fields stay."""
    builder = Builder(data)
    root = next(k for k, (v, _) in builder.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog")
    catalog = builder.objects[root][0]
    held = {"Fields": [], **builder.file.get(catalog.get("AcroForm"), {})}
    form = held | {"XFA": [b"template", builder.add({}, xml)], "NeedAppearances": True}
    builder.objects[root] = (catalog | {"AcroForm": form}, None)
    return builder.written(root)


def fillable_files(found: DataFrame, specs: DataFrame) -> DataFrame:
    """(path, content): PDF files (path, content) with widgets for their specs (path, page, name, type, x, y, w, h[, value]).

    One file is built in one task; files without specs are left out. Fields keep the order of page, y and x.
    """

    def build(paths, files, rows):
        for content in files if rows else ():
            yield paths[0], Builder(content).built(rows)

    return with_specs(found, specs, build, "path string, content binary")


def with_specs(found: DataFrame, specs: DataFrame, fn: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `fn` makes of each path's files and specs in order; both are dealt and sorted once, together."""
    kinds = {"page": "int", "under": "double", "x": "double", "name": "string", "type": "string", "w": "double", "h": "double", "value": "string"}
    value = F.col("value") if "value" in specs.columns else F.lit(None)
    own = {"page": F.col("page"), "under": -F.col("y"), "value": value}
    rows = specs.select("path", F.lit(True).alias("spec"), F.lit(None).cast("binary").alias("content"), *[own.get(c, F.col(c)).cast(k).alias(c) for c, k in kinds.items()])
    files = found.select("path", F.lit(False).alias("spec"), "content", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])

    def each(paths, marks, contents, *columns):
        n = marks.index(True) if True in marks else len(marks)
        rows = [(page, name, kind, x, -under, w, h, value) for page, under, x, name, kind, w, h, value in zip(*(c[n:] for c in columns))]
        return fn(paths, contents[:n], rows)

    order = ["spec", "page", "under", "x", "name", "type", "w", "h", "value"]
    return map_groups(files.unionByName(rows).where("path is not null"), "path", order, each, schema)
