"""Zip packages with guards, and XML as events or small trees."""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import unescape
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from ..errors import WorkbookError

MOST_PART, MOST_RATIO, RATIO_FLOOR = 2 << 30, 300, 8 << 20
CHUNK = 1 << 16


class Package:
    """Parts by name.  Sizes are counted while inflating, so a part that lies about its size is caught."""

    def __init__(self, data: bytes, most_part: float = MOST_PART, most_ratio: float = MOST_RATIO) -> None:
        self.most_part, self.most_ratio = most_part, most_ratio
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            known = data.rfind(b"PK\5\6") >= 0
            raise WorkbookError("corrupt-zip" if known else "not-a-zip", str(e)) from None
        except (NotImplementedError, ValueError, OverflowError, EOFError, IndexError, UnicodeDecodeError) as e:
            raise WorkbookError("corrupt-zip", str(e)) from None
        self.parts: dict[str, zipfile.ZipInfo] = {}
        for info in self.zip.infolist():
            if info.is_dir():
                continue
            if info.filename in self.parts:
                raise WorkbookError("corrupt-zip", f"two parts named {info.filename!r}")
            if info.extra and 0xFFFFFFFF in (info.file_size, info.compress_size):
                raise WorkbookError("unsupported", "ZIP64")
            self.parts[info.filename] = info

    def __contains__(self, name: str) -> bool:
        return name in self.parts

    def chunks(self, name: str) -> Iterator[bytes]:
        info = self.parts.get(name)
        if info is None:
            raise WorkbookError("missing-part", f"no part {name!r}")
        if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise WorkbookError("unsupported", f"{name}: encrypted or an unknown method")
        total = 0
        try:
            with self.zip.open(info) as f:
                while chunk := f.read(CHUNK):
                    total += len(chunk)
                    if total > self.most_part or (total > RATIO_FLOOR and total > self.most_ratio * max(1, info.compress_size)):
                        raise WorkbookError("part-too-large", name)
                    yield chunk
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError, struct.error) as e:
            raise WorkbookError("corrupt-zip", f"{name}: {e}") from None

    def read(self, name: str) -> bytes:
        return b"".join(self.chunks(name))

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id: (type's last word, target, external) of a part's relationships; targets are part names."""
        folder, base = posixpath.split(part)
        name = posixpath.join(folder, "_rels", base + ".rels")
        if name not in self:
            return {}
        out = {}
        for e in tree(self.chunks(name)).all("Relationship"):
            external = e.get("TargetMode") == "External"
            target = e.get("Target", "")
            if not external:
                target = posixpath.normpath(posixpath.join(folder, target)) if not target.startswith("/") else target[1:]
            out[e.get("Id", "")] = (e.get("Type", "").rsplit("/", 1)[-1], target, external)
        return out


# --- XML ------------------------------------------------------------------------------------------

Handler = tuple[Callable[[str, dict[str, str]], None], Callable[[str], None], Callable[[str], None]]


def local(name: str) -> str:
    return name.rpartition(":")[2]


def _last_tag(held: bytes, upto: int) -> tuple[int, int]:
    """Where the last whole tag before ``upto`` begins and ends."""
    at = upto
    while (at := held.rfind(b"<", 0, at)) >= 0:
        m = _PIECE.match(held, at)
        if m is not None and m[3] is not None and m.end() <= upto:
            return at, m.end()
    return 0, 0


def parse_events(chunks: Iterator[bytes], open_: Callable, close: Callable, text: Callable) -> None:
    for _ in parse_steps(chunks, open_, close, text):
        pass


def parse_steps(chunks: Iterator[bytes], open_: Callable, close: Callable, text: Callable) -> Iterator[None]:
    """Calls back for each element and text; a step for each chunk, so that a caller can stop.  Entities are never expanded.

    Where expat rejects what follows, a tolerant scan goes on after the last tag, without the characters that have been told since.
    """
    parser = expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, 1 << 18  # more than the text of a cell can have
    told: list[tuple[int, int]] = []  # places and lengths of texts since the last tag of the chunk before

    def tell(s: str) -> None:
        told.append((parser.CurrentByteIndex, len(s)))
        text(s)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = open_, close, tell
    parser.EntityDeclHandler = lambda *a: (_ for _ in ()).throw(WorkbookError("unsupported", "entity declarations"))
    chunks = iter(chunks)
    held, before, utf8 = b"", 0, None  # bytes from the last tag on, and how many came before them
    try:
        for chunk in chunks:
            if utf8 is None:  # without a mark or a declaration, it is
                utf8 = not re.search(rb"encoding=[\"'](?!utf-?8|us-ascii)", chunk[:200], re.I) and not chunk.startswith((b"\xff\xfe", b"\xfe\xff", b"<\0", b"\0<"))
            start, end = _last_tag(held, max(0, parser.CurrentByteIndex - before))
            told[:] = [t for t in told if t[0] >= before + end]
            held, before = held[start:] + chunk, before + start
            parser.Parse(chunk, False)
            yield
        parser.Parse(b"", True)
    except expat.ExpatError:
        if not utf8:
            raise WorkbookError("unsupported", "malformed XML that is not in UTF-8") from None
        end = _last_tag(held, parser.ErrorByteIndex - before)[1]
        known = sum(n for at, n in told if at >= before + end)
        for kind, value, attributes in scan(itertools.chain([held[end:]], chunks)):
            if kind != "text":
                known = 0
                open_(value, attributes) if kind == "open" else close(value)
            elif len(value) > known:
                text(value[known:])
                known = 0
            else:
                known -= len(value)
            yield


#: One piece of malformed XML at a time, none of them cut by the end of a buffer: comment, CDATA, instruction, declaration, tag.
_PIECE = re.compile(rb"<!--(?:.*?)-->|<!\[CDATA\[(.*?)\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([^\s/>=<][^\s/><]*)((?:[^>\"'<]|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>/]+))")
_MOST_HELD = 1 << 24


def _settled(held: bytes, at: int) -> int:
    """The end of text that no reference or character goes on beyond."""
    end = len(held)
    start = held.rfind(b"&", max(at, end - 12))
    end = start if start >= 0 else end
    lead = end
    while lead > max(at, end - 3) and held[lead - 1] & 0xC0 == 0x80:
        lead -= 1
    return lead - 1 if lead > at and held[lead - 1] >= 0xC0 else end


def scan(chunks: Iterator[bytes]) -> Iterator[tuple[str, str, dict[str, str]]]:
    """A scanner that never fails: (open, name, attributes), (close, name, {}), (text, value, {}).

    A ``<`` that begins nothing is text, and so is an ``&`` that is no reference.
    """
    held, more = b"", True
    chunks = iter(chunks)
    while more:
        chunk = next(chunks, None)
        more = chunk is not None
        held += chunk or b""
        at = 0
        while at < len(held):
            if held[at : at + 1] != b"<":
                end = held.find(b"<", at)
                last = end < 0
                if last:
                    end = _settled(held, at) if more else len(held)
                if end > at:
                    yield "text", unescape(held[at:end].decode("utf-8", "replace")), {}
                at = end
                if last:
                    break
                continue
            m = _PIECE.match(held, at)
            if m is None:
                if more and len(held) - at < _MOST_HELD and b">" not in held[at : at + 4096]:
                    break  # the piece may end in a later chunk
                yield "text", "<", {}
                at += 1
                continue
            at = m.end()
            if m[3] is not None:
                name = m[3].decode("utf-8", "replace")
                if m[2]:
                    yield "close", name, {}
                    continue
                yield "open", name, {k: unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4].decode("utf-8", "replace"))}
                if m[5]:
                    yield "close", name, {}
            elif m[1] is not None:
                yield "text", m[1].decode("utf-8", "replace"), {}
        held = held[at:]


class Element:
    """A small tree: local name, attributes with local names, children, text."""

    __slots__ = ("attributes", "children", "name", "text")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children, self.text = local(name), {local(k): v for k, v in attributes.items()}, [], ""

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.attributes.get(key, default)

    def first(self, name: str) -> Element | None:
        return next((c for c in self.children if c.name == name), None)

    def all(self, name: str) -> list[Element]:
        """All descendants of that name, in order."""
        out, stack = [], list(reversed(self.children))
        while stack:
            e = stack.pop()
            if e.name == name:
                out.append(e)
            stack += reversed(e.children)
        return out

    def xml(self) -> str:
        """As XML again, without namespaces."""
        a = "".join(f" {k}={quoteattr(v)}" for k, v in self.attributes.items() if k != "xmlns")
        return f"<{self.name}{a}>{escape(self.text)}{''.join(c.xml() for c in self.children)}</{self.name}>"

    def data(self) -> object:
        """Attributes and children as plain values for JSON."""
        out: dict[str, object] = dict(self.attributes)
        for c in self.children:
            out.setdefault(c.name, []).append(c.data()) if isinstance(out.get(c.name, []), list) else None
        if self.text.strip():
            out["text"] = self.text
        return out


class Builder:
    """Builds trees from events."""

    def __init__(self) -> None:
        self.root = Element("", {})
        self.stack = [self.root]

    def open(self, name: str, attributes: dict[str, str]) -> None:
        e = Element(name, attributes)
        self.stack[-1].children.append(e)
        self.stack.append(e)

    def close(self, name: str) -> None:
        # in malformed XML, a close ends the innermost element of that name, and none if there isn't one
        depth = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].name == local(name)), 0)
        if depth:
            del self.stack[depth:]

    def data(self, s: str) -> None:
        self.stack[-1].text += s


def tree(chunks: Iterator[bytes]) -> Element:
    b = Builder()
    parse_events(chunks, b.open, b.close, b.data)
    return b.root


_ESCAPE = re.compile("_x([0-9A-Fa-f]{4})_")


def unescape_text(s: str) -> str:
    """``_x000D_`` and the like, in text that a file stores; surrogate pairs are joined."""
    if "_x" not in s:
        return s
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), s)
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass") if out != s else s


_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f￾￿\ud800-\udfff]|_(?=x[0-9A-Fa-f]{4}_)")


def escape_text(s: str) -> str:
    return _UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", s)
