"""A small reader of PDF files: the text of each page, as far as it is written in simple fonts.

It follows the page tree, undoes Flate compression (object streams included) and reads the strings that a page's content
shows, by the fonts' ToUnicode tables where they have one. Encrypted files and files without a page are refused. For
anything else (scans, unusual filters) pass a reader of your own to `files.pages`.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOWN = re.compile(
    rb"(?P<array>\[(?:[^\[\]()<>]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)*\])\s*TJ"
    rb"|(?P<string>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")"
    rb"|/(?P<font>[^\s/<>\[\]()]+)\s+[\d.+-]+\s+Tf|(?P<move>[\d.+-]+)\s+(?P<down>[\d.+-]+)\s+T[dD]\b|(?P<next>T\*|\bET\b|(?:[\d.+-]+\s+){6}Tm\b)",
    re.DOTALL,
)
_PIECE = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\d.+-]+", re.DOTALL)
#: Escapes inside strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift of more than this part of the font's size, in thousandths, is a space.
_GAP = 180.0


class Pdf:
    def __init__(self, content: bytes) -> None:
        if not content.lstrip()[:5] == b"%PDF-":
            raise ValueError("The file is no PDF")
        if re.search(rb"/Encrypt\s+(?:\d+\s+\d+\s+R|<<)", content):
            raise ValueError("The PDF is encrypted and its text may not be read")
        self.objects: dict[int, bytes] = {int(m.group(1)): m.group(3) for m in _OBJECT.finditer(content)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b]:
            self.unpack(body)

    def unpack(self, body: bytes) -> None:
        """The objects inside an object stream."""
        data, first = self.stream(body), re.search(rb"/First\s+(\d+)", body)
        if not first:
            return
        start = int(first.group(1))
        numbers = list(map(int, data[:start].split()))
        places = [*zip(numbers[::2], numbers[1::2], strict=False), (0, len(data) - start)]
        for (number, at), (_, end) in zip(places, places[1:], strict=False):
            self.objects.setdefault(number, data[start + at : start + end])

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" not in body[: m.start()]:
            return m.group(1)
        return zlib.decompressobj().decompress(m.group(1))

    def named(self, body: bytes, name: bytes) -> bytes:
        """What a dictionary holds under a name, references followed."""
        m = re.search(rb"/" + name + rb"\s*(\d+\s+\d+\s+R|<<.*|\[.*?\])", body, re.DOTALL)
        if not m:
            return b""
        reference = _REFERENCE.fullmatch(m.group(1))
        return self.objects.get(int(reference.group(1)), b"") if reference else m.group(1)

    def pages(self, body: bytes | None = None, above: bytes = b"", seen: frozenset[int] = frozenset()) -> list[tuple[bytes, bytes]]:
        """(page, resources) in order; resources may stand higher up in the tree."""
        if body is None:
            root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
            body = self.named(root, b"Pages")
        held = self.named(body, b"Resources") or above
        if re.search(rb"/Type\s*/Page\b", body):
            return [(body, held)]
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)
        found = []
        for number in map(int, _REFERENCE.findall(kids.group(1)) if kids else ()):
            if number not in seen:
                found += self.pages(self.objects.get(number, b""), held, seen | {number})
        return found

    def fonts(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """Name -> table of codes to text, for fonts that have one."""
        block = self.named(resources, b"Font")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", block):
            table = self.named(self.objects.get(int(number), b""), b"ToUnicode")
            if table:
                out[name] = unicode_table(self.stream(table))
        return out

    def text(self, page: bytes, resources: bytes) -> str:
        """The strings a page shows, a line for each move to another one."""
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.DOTALL)
        data = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in _REFERENCE.findall(contents.group(1))) if contents else b""
        fonts, table, out = self.fonts(resources), {}, []
        for m in _SHOWN.finditer(data):
            if m.group("font") is not None:
                table = fonts.get(m.group("font"), {})
            elif m.group("string") is not None:
                out.append(decoded(m.group("string"), table))
            elif m.group("array") is not None:
                for piece in _PIECE.findall(m.group("array")[1:-1]):
                    out.append(decoded(piece, table) if piece[:1] in b"(<" else " " if float(piece) < -_GAP else "")
            elif m.group("next") is not None or float(m.group("down")):
                out.append("\n")
            else:
                out.append(" ")
        return re.sub(r" *\n[ \n]*", "\n", "".join(out)).strip()


def decoded(string: bytes, table: dict[bytes, str]) -> str:
    """A string's text: by the table's codes of one or two bytes, else as Latin text."""
    if string[:1] == b"<":
        digits = re.sub(rb"\s", b"", string[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\(\r?\n|[0-7]{1,3}|.)", lambda m: b"" if m.group(1)[-1:] == b"\n" else bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1] in b"01234567" else _ESCAPES.get(m.group(1), m.group(1)), string[1:-1], flags=re.DOTALL)
    if table:
        size = max(map(len, table))
        return "".join(table.get(raw[at : at + size], "") for at in range(0, len(raw), size))
    return raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace")


def unicode_table(source: bytes) -> dict[bytes, str]:
    """Codes to text from a ToUnicode table: single codes and ranges."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.DOTALL):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.DOTALL):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, size = int(low, 16), len(low) // 2
            for code in range(first, min(int(high, 16), first + 65_535) + 1):
                value = int(to, 16) + code - first
                out[code.to_bytes(size, "big")] = value.to_bytes(len(to) // 2, "big").decode("utf-16-be", "replace")
    return out


def read(content: bytes) -> list[str]:
    """The text of each page, in order."""
    pdf = Pdf(content)
    pages = pdf.pages()
    if not pages:
        raise ValueError("The PDF has no page")
    return [pdf.text(page, resources) for page, resources in pages]
