"""Text of PDF pages by the places of their glyphs: what a task needs to read one uploaded file.

Reads cross-reference tables and streams (or, where they are broken, looks for objects), object streams, Flate data and
character maps. Glyphs are put in rows by height and in order by place; a gap becomes as many blanks as fit, a tall gap
between rows an empty line. Encrypted files, pictures of text and fonts without a character map or a common encoding
give no text or an error.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass, field

_SPACE, _END = b"\0\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_PLAIN = re.compile(rb"[^\\()]+")  # of a string: neither escaped nor nested
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\x0c"}


class Name(str):
    """/Name"""


class Word(str):
    """An operator or a keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    data: bytes


def _objects(data: bytes, at: int = 0, end: int | None = None):
    """Values from a place on: numbers, bytes, names, words, lists, dicts, each with where it ends. References are put together by ``_value``."""
    end = len(data) if end is None else end
    stack: list[list] = []
    while at < end:
        c = data[at]
        done = None
        if c in _SPACE:
            at += 1
            continue
        if c == 0x25:  # comment
            at = next((i for i in range(at, end) if data[i] in b"\r\n"), end)
            continue
        if c == 0x28:
            done, at = _string(data, at + 1)
        elif data[at : at + 2] in (b"<<", b">>") or c in b"[]{}":
            two = data[at : at + 2] in (b"<<", b">>")
            at += 1 + two
            if c in b"<[{":
                stack.append([])
                continue
            if not stack:
                continue
            items = _linked(stack.pop())
            done = dict(zip(items[::2], items[1::2], strict=False)) if two else items
        elif c == 0x3C:
            close = data.find(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:close])
            done, at = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), close + 1
        elif c == 0x2F:
            m = _TOKEN.match(data, at + 1)
            raw, at = (m[0], m.end()) if m else (b"", at + 1)
            done = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), raw).decode("latin-1"))
        elif m := _TOKEN.match(data, at):
            at, word = m.end(), m[0].decode("latin-1")
            done = float(word) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", word) else Word(word)
        else:
            at += 1
            continue
        if stack:
            stack[-1].append(done)
        else:
            yield done, at


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C:
            m = re.compile(rb"[0-7]{1,3}").match(data, at)
            if m:
                out.append(int(m[0], 8) & 255)
                at = m.end()
            else:
                out += b"" if data[at : at + 1] in (b"\n", b"\r") else _ESCAPES.get(data[at], data[at : at + 1])
                at += 1
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(c)
        m = _PLAIN.match(data, at)
        if m:
            out += m[0]
            at = m.end()
    return bytes(out), at


def _linked(items: list) -> list:
    """Items with ``number generation R`` as a reference."""
    out: list = []
    for x in items:
        if isinstance(x, Word) and x == "R" and len(out) > 1:
            out[-2:] = [Ref(int(out[-2]))]
        else:
            out.append({"true": True, "false": False, "null": None}.get(x, x) if isinstance(x, Word) else x)
    return out


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.held, self.places, self.inside, self.trailer = data, {}, {}, {}, {}
        try:
            m = re.findall(rb"startxref\s+(\d+)", data)
            self._table(int(m[-1]), set())
            self.pages()
        except Exception:  # a broken table: look for the objects themselves, later ones count
            self.held, self.inside, self.trailer = {}, {}, {}
            self.places = {int(m[1]): m.start() for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b", data)}
            for m in re.finditer(rb"trailer", data):
                self.trailer |= next(_objects(data, m.end()))[0]
            for n in list(self.places):
                self._listed(self.get(Ref(n)))
        if "Encrypt" in self.trailer:
            raise ValueError("the PDF file is encrypted")

    def _listed(self, x) -> None:
        kind = x.info.get("Type") if isinstance(x, Stream) else x.get("Type") if isinstance(x, dict) else None
        if kind == "ObjStm":
            numbers = [int(v) for v, _ in _objects(self.decoded(x), 0, int(self.get(x.info["First"])))]
            for n, offset in zip(numbers[::2], numbers[1::2], strict=False):
                self.held[n] = _value(self.decoded(x), int(self.get(x.info["First"])) + offset)[0]
        elif kind == "XRef":
            self.trailer = x.info | self.trailer
        elif kind == "Catalog" and "Root" not in self.trailer:
            self.trailer["Root"] = x

    def _table(self, at: int, seen: set[int]) -> None:
        if at in seen:
            return
        seen.add(at)
        m = re.compile(rb"\s*xref\s*").match(self.data, at)
        if m:
            at = m.end()
            while m := re.compile(rb"(\d+) (\d+)\s*").match(self.data, at):
                first, n, at = int(m[1]), int(m[2]), m.end()
                for i in range(n):
                    entry = self.data[at + 20 * i : at + 20 * i + 20].split()
                    if entry[2] == b"n":
                        self.places.setdefault(first + i, int(entry[0]))
                at += 20 * n
            info, _ = next(_objects(self.data, self.data.index(b"trailer", at) + 7))
            if "XRefStm" in info:
                self._table(int(info["XRefStm"]), seen)
        else:
            stream = self._at(at)
            info, rows, widths = stream.info, self.decoded(stream), [int(w) for w in stream.info["W"]]
            index = [int(x) for x in info.get("Index", [0, info["Size"]])]
            numbers = [first + i for first, n in zip(index[::2], index[1::2], strict=False) for i in range(n)]
            for k, n in enumerate(numbers):
                row, part = rows[k * sum(widths) : (k + 1) * sum(widths)], []
                for w in widths:
                    part.append(int.from_bytes(row[:w], "big") if w else 1)
                    row = row[w:]
                if part[0] == 1:
                    self.places.setdefault(n, part[1])
                elif part[0] == 2 and n not in self.places:
                    self.inside.setdefault(n, part[1])
        self.trailer = info | self.trailer
        if "Prev" in info:
            self._table(int(info["Prev"]), seen)

    def _at(self, at: int):
        """The object whose ``number generation obj`` is at a place."""
        value, end = _value(self.data, re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at).end())
        m = re.compile(rb"\s*stream\r?\n").match(self.data, end)
        if not isinstance(value, dict) or not m:
            return value
        size = self.get(value.get("Length"))
        until = m.end() + int(size) if isinstance(size, float) else -1
        if not re.compile(rb"\s*endstream").match(self.data, max(until, 0)):
            until = self.data.index(b"endstream", m.end())
        return Stream(value, self.data[m.end() : until])

    def get(self, x):
        """A value, references followed."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.held and x.number in self.places:
                self.held[x.number] = self._at(self.places[x.number])
            elif x.number not in self.held and x.number in self.inside:
                self._listed(self.get(Ref(self.inside[x.number])))
            x = self.held.get(x.number)
        return None

    def decoded(self, x: Stream) -> bytes:
        data, kinds, parms = x.data, self.get(x.info.get("Filter")) or [], self.get(x.info.get("DecodeParms")) or {}
        kinds = kinds if isinstance(kinds, list) else [kinds]
        for kind, parm in zip(kinds, parms if isinstance(parms, list) else [parms] * len(kinds), strict=False):
            if kind != "FlateDecode":
                raise ValueError(f"data coded by {kind} can't be read")
            data = zlib.decompressobj().decompress(data)
            parm = self.get(parm) or {}
            if self.get(parm.get("Predictor", 1)) >= 10:
                data = _unpredicted(data, int(self.get(parm.get("Columns", 1))))
        return data

    def pages(self) -> list[dict]:
        out: list[dict] = []
        todo, seen = [(self.get(self.get(self.trailer["Root"])["Pages"]), None)], 0
        while todo:
            node, resources = todo.pop()
            seen += 1
            resources = self.get(node.get("Resources")) or resources
            if "Kids" in node and seen < 1_000_000:
                todo += [(kid, resources) for k in reversed(self.get(node["Kids"])) if isinstance(kid := self.get(k), dict)]
            elif "Kids" not in node:
                out.append(node | {"Resources": resources or {}})
        return out


def _value(data: bytes, at: int):
    """One value and where it ends; a reference only as an item of another value or as the whole."""
    values = _objects(data, at)
    value, end = next(values)
    if isinstance(value, float):
        rest = re.compile(rb"\s+\d+\s+R\b").match(data, end)
        if rest:
            return Ref(int(value)), rest.end()
    return value, end


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows of PNG prediction undone: none, left, up, mean, nearest of three (one byte a column)."""
    out, before = bytearray(), bytearray(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left, up, corner = row[i - 1] if i else 0, before[i], before[i - 1] if i else 0
            near = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            row[i] = (row[i] + (0, left, up, (left + up) // 2, near)[kind]) & 255
        out += row
        before = row
    return bytes(out)


@dataclass
class Font:
    """How codes are read: bytes a code, code -> text, code -> width in thousandths."""

    size: int = 1
    text: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    plain: float = 500.0

    def read(self, data: bytes):
        for i in range(0, len(data) - self.size + 1, self.size):
            code = int.from_bytes(data[i : i + self.size], "big")
            yield code, self.text.get(code, ""), self.widths.get(code, self.plain) / 1000


def _mapped(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes a code and code -> text, of a character map."""
    out, size, held = {}, 1, []
    text = lambda b: b.decode("utf-16-be", "replace")
    for x, _ in _objects(data):
        if not isinstance(x, Word):
            held.append(x)
            continue
        if x == "endcodespacerange" and held:
            size = len(held[0])
        elif x == "endbfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
        elif x == "endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(min(last - first + 1, 1 << 16)):
                    out[first + k] = text(c[k]) if isinstance(c, list) and k < len(c) else text((int.from_bytes(c, "big") + k).to_bytes(len(c), "big")) if isinstance(c, bytes) else ""
        held = []
    return size, out


@functools.cache
def _encoding(name: str) -> dict[int, str]:
    return {c: bytes([c]).decode(name, "ignore") for c in range(256)}


def _font(doc: Document, info: dict) -> Font:
    out, inner = Font(), doc.get((doc.get(info.get("DescendantFonts")) or [None])[0])
    if inner:
        out.size, out.plain, items = 2, float(doc.get(inner.get("DW", 1000.0))), doc.get(inner.get("W")) or []
        while items:  # first [widths], or first last width
            first, second = int(items[0]), doc.get(items[1])
            if isinstance(second, list):
                out.widths |= {first + k: doc.get(w) for k, w in enumerate(second)}
                items = items[2:]
            else:
                out.widths |= dict.fromkeys(range(first, int(second) + 1), doc.get(items[2]))
                items = items[3:]
    else:
        encoding = doc.get(info.get("Encoding"))
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        out.text = dict(_encoding("mac-roman" if base == "MacRomanEncoding" else "cp1252"))
        at = 0
        for x in (doc.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            if isinstance(x, float):
                at = int(x)
                continue
            m = re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", x)
            out.text[at] = x if len(x) == 1 else chr(int(m[1], 16)) if m else " " if x == "space" else out.text.get(at, "")
            at += 1
        begin = int(doc.get(info.get("FirstChar", 0.0)))
        out.widths = {begin + k: doc.get(w) for k, w in enumerate(doc.get(info.get("Widths")) or [])}
    if isinstance(stream := doc.get(info.get("ToUnicode")), Stream):
        size, text = _mapped(doc.decoded(stream))
        out.size, out.text = (size if inner else 1), out.text | text
    return out


def _times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _glyphs(doc: Document, data: bytes, resources: dict, ctm, depth: int = 0) -> list[tuple[float, float, float, float, str]]:
    """(x, y, end, height, text) of the glyphs that a page's content draws."""
    out, stack, held = [], [], []
    fonts, forms = doc.get(resources.get("Font")) or {}, doc.get(resources.get("XObject")) or {}
    known: dict[str, Font] = {}
    font, size, char, word, lead, wide, rise = Font(), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    tm = line = _ONE

    def show(raw: bytes) -> None:
        nonlocal tm
        if font.size == 1 and not (tm[1] or tm[2] or ctm[1] or ctm[2]):
            # upright text moves along its line alone: the same products as below without those by zero
            scale, height, y, x = size * wide * tm[0] * ctm[0], size * tm[3] * ctm[3], (rise * tm[3] + tm[5]) * ctm[3] + ctm[5], tm[4]
            high, (read, widths, plain) = abs(height) or abs(scale) or 1.0, (font.text.get, font.widths.get, font.plain)
            for code in raw:
                width = widths(code, plain) / 1000
                if text := read(code, ""):
                    begin = x * ctm[0] + ctm[4]
                    out.append((begin, y, begin + width * scale, high, text))
                x += (width * size + char + (word if code == 32 else 0)) * wide * tm[0]
            tm = (*tm[:4], x, tm[5])
            return
        for code, text, width in font.read(raw):
            at = _times((size * wide, 0, 0, size, 0, rise), _times(tm, ctm))
            step = (width * size + char + (word if code == 32 and font.size == 1 else 0)) * wide
            tm = _times((1, 0, 0, 1, step, 0), tm)
            if text:
                out.append((at[4], at[5], at[4] + width * at[0], abs(at[3]) or abs(at[0]) or 1.0, text))

    for x, _ in _objects(data):
        if not isinstance(x, Word):
            held.append(x)
            continue
        a, held, n = held, [], str(x)
        try:
            if n == "q":
                stack.append((ctm, font, size, char, word, lead, wide, rise))
            elif n == "Q" and stack:
                ctm, font, size, char, word, lead, wide, rise = stack.pop()
            elif n == "cm":
                ctm = _times(tuple(a[-6:]), ctm)
            elif n == "BT":
                tm = line = _ONE
            elif n == "Tf":
                font = known.get(a[0]) or known.setdefault(a[0], _font(doc, doc.get(fonts[a[0]])))
                size = a[1]
            elif n in ("Tc", "Tw", "TL", "Tz", "Ts"):
                char, word, lead, wide, rise = (a[0] if n == "Tc" else char, a[0] if n == "Tw" else word, a[0] if n == "TL" else lead, a[0] / 100 if n == "Tz" else wide, a[0] if n == "Ts" else rise)
            elif n in ("Td", "TD", "T*", "'", '"'):
                if n == "TD":
                    lead = -a[1]
                if n == '"':
                    word, char = a[0], a[1]
                tm = line = _times((1, 0, 0, 1, *(a[:2] if n in ("Td", "TD") else (0, -lead))), line)
                if n in ("'", '"'):
                    show(a[-1])
            elif n == "Tm":
                tm = line = tuple(a[-6:])
            elif n == "Tj":
                show(a[0])
            elif n == "TJ":
                for part in a[0]:
                    if isinstance(part, bytes):
                        show(part)
                    else:
                        tm = _times((1, 0, 0, 1, -part / 1000 * size * wide, 0), tm)
            elif n == "Do" and depth < 8 and isinstance(form := doc.get(forms.get(a[0])), Stream) and form.info.get("Subtype") == "Form":
                matrix = tuple(doc.get(form.info.get("Matrix")) or _ONE)
                out += _glyphs(doc, doc.decoded(form), doc.get(form.info.get("Resources")) or resources, _times(matrix, ctm), depth + 1)
        except (IndexError, KeyError, TypeError, AttributeError):
            continue  # an operator that lacks its operands draws nothing
    return out


def laid_out(glyphs: list[tuple[float, float, float, float, str]]) -> str:
    """Glyphs as lines: rows from the top, each from the left, gaps as blanks."""
    rows: list[list] = []
    for g in sorted(glyphs, key=lambda g: (-g[1], g[0])):
        if rows and abs(rows[-1][0][1] - g[1]) <= 0.4 * g[3]:
            rows[-1].append(g)
        else:
            rows.append([g])
    lines: list[str] = []
    for i, row in enumerate(rows):
        row.sort(key=lambda g: g[0])
        if i and rows[i - 1][0][1] - row[0][1] > 1.9 * max(row[0][3], rows[i - 1][0][3]):
            lines.append("")
        text, end = "", row[0][0]
        for x, _, until, height, t in row:
            gap = x - end
            if gap > 0.15 * height and not text.endswith(" ") and not t.startswith(" ") or gap > 0.6 * height:
                text += " " * max(1, round(gap / (0.3 * height)))
            text, end = text + t, until
        lines.append(text.rstrip())
    return "\n".join(lines)


def pages(data: bytes) -> list[str]:
    """The text of each page."""
    doc = Document(data)
    out = []
    for page in doc.pages():
        parts = doc.get(page.get("Contents")) or []
        streams = [doc.get(p) for p in (parts if isinstance(parts, list) else [parts])]
        content = b"\n".join(doc.decoded(s) for s in streams if isinstance(s, Stream))
        out.append(laid_out(_glyphs(doc, content, page["Resources"], _ONE)))
    return out
