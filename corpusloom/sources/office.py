"""Office containers, mail and images from their bytes, with the standard library only.

The readers are for untrusted input: sizes are bounded before anything is inflated, documents with a DOCTYPE are
refused, and any fault is a row (code, message) instead of an exception.
"""

from __future__ import annotations

import email
import email.policy
import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.html import visible_text

#: bytes of a container and of what it may inflate to, so that a task's memory is bounded; larger ones are rows with code
#: too-large. ``read_text`` takes others.
LIMITS = (64 << 20, 256 << 20)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Refused(ValueError):
    """A container that isn't read; the first argument is the code."""


def _open(content: bytes, limits: tuple[int, int] = LIMITS) -> zipfile.ZipFile:
    if len(content) > limits[0]:
        raise Refused("too-large")
    try:
        box = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as fault:
        raise Refused("not-a-package") from fault
    names = [i.filename for i in box.infolist()]
    if sum(i.file_size for i in box.infolist()) > limits[1]:
        raise Refused("too-large")
    if len(set(names)) < len(names) or any(n.startswith("/") or ".." in n.split("/") for n in names):
        raise Refused("unsafe-members")
    return box


def _part(box: zipfile.ZipFile, name: str) -> bytes:
    try:
        raw = box.read(name)
    except KeyError as fault:
        raise Refused(f"missing:{name}") from fault
    except zipfile.BadZipFile as fault:  # the checksum isn't that of the content
        raise Refused(f"corrupt:{name}") from fault
    if b"<!DOCTYPE" in raw[:4096]:
        raise Refused("doctype")
    return raw


def _xml(box: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(_part(box, name))


#: what elements of a Word paragraph stand for, besides the text of w:t
_WORD_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def docx_paragraphs(content: bytes, limits: tuple[int, int] = LIMITS) -> Iterator[str]:
    """Text of the paragraphs of a Word document in the order in which they begin, the empty ones too.

    The part is read as a stream. A paragraph inside another (a text box) gives its text to both.
    """
    began: list[list[str]] = []  # all paragraphs
    inside: list[list[str]] = []  # those that are open
    for event, x in ET.iterparse(io.BytesIO(_part(_open(content, limits), "word/document.xml")), ("start", "end")):
        if x.tag == f"{_W}p":
            if event == "start":
                inside.append([])
                began.append(inside[-1])
            else:
                inside.pop()
                x.clear()
        elif event == "end" and (mark := x.text if x.tag == f"{_W}t" else _WORD_MARKS.get(x.tag)):
            for parts in inside:
                parts.append(mark)
    return map("".join, began)


def docx_text(content: bytes, limits: tuple[int, int] = LIMITS) -> str:
    """Paragraphs that say something, with blank lines between."""
    return "\n\n".join(filter(None, map(str.strip, docx_paragraphs(content, limits))))


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(row), col


#: fixed values: number formats that are dates, times or both
_DATES, _TIMES = frozenset(range(14, 18)) | {22}, frozenset({18, 19, 20, 21, 45, 46, 47})


def _date_styles(box: zipfile.ZipFile) -> dict[int, bool]:
    """Cell styles that show dates or times, and whether they show a date."""
    if "xl/styles.xml" not in box.namelist():
        return {}
    root, out = _xml(box, "xl/styles.xml"), {}
    custom = {int(x.get("numFmtId", -1)): re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", x.get("formatCode", "")).lower() for x in root.iter(f"{_S}numFmt")}
    for style, x in enumerate(root.findall(f"{_S}cellXfs/{_S}xf")):
        k = int(x.get("numFmtId", 0))
        if k in _DATES or re.search("[yd]", custom.get(k, "")):
            out[style] = True
        elif k in _TIMES or re.search("[hs]", custom.get(k, "")):
            out[style] = False
    return out


def _moment(serial: float, dated: bool, from_1904: bool) -> str:
    """A day's number with its fraction as ISO text; without a date, below a day, the time alone."""
    at = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(days=serial + (not from_1904 and 0 < serial < 60))
    at = (at + timedelta(microseconds=500)).replace(microsecond=(at + timedelta(microseconds=500)).microsecond // 1000 * 1000)
    return (at if dated or serial >= 1 else at.time()).isoformat()


def _sheet_parts(box: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order; sheets without a relationship are left out."""
    targets = {r.get("Id"): r.get("Target") for r in _xml(box, "xl/_rels/workbook.xml.rels")}
    for sheet in _xml(box, "xl/workbook.xml").iter(f"{_S}sheet"):
        if part := targets.get(sheet.get(f"{_R}id")):
            yield sheet.get("name"), part.lstrip("/") if part.startswith("/") else f"xl/{part}"


def xlsx_cells(content: bytes, limits: tuple[int, int] = LIMITS) -> list[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of all cells with a cached value, in the order of sheets; dates as ISO text."""
    box = _open(content, limits)
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(box, "xl/sharedStrings.xml").iter(f"{_S}si")] if "xl/sharedStrings.xml" in box.namelist() else []
    dates = _date_styles(box)
    from_1904 = any(x.get("date1904") in ("1", "true") for x in _xml(box, "xl/workbook.xml").iter(f"{_S}workbookPr"))

    def number(text: str, style: int) -> str:
        x = float(text)
        if style in dates and x >= 0:
            return _moment(x, dates[style], from_1904)
        return str(int(x)) if x.is_integer() else repr(x)

    def value(c: ET.Element) -> str | None:
        kind, v = c.get("t"), c.find(f"{_S}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None or v.text is None:
            return None
        read = {"s": lambda t: shared[int(t)], "b": lambda t: "TRUE" if t == "1" else "FALSE", "str": str, "e": str, "d": str}
        return read[kind](v.text) if kind in read else number(v.text, int(c.get("s", 0)))

    cells = ((name, *_place(c.get("r")), value(c)) for name, part in _sheet_parts(box) for c in _xml(box, part).iter(f"{_S}c"))
    return [x for x in cells if x[3] is not None]


def xlsx_merges(content: bytes, limits: tuple[int, int] = LIMITS) -> list[tuple[str, int, int, int, int]]:
    """(sheet, r1, c1, r2, c2) of the merged ranges."""
    box, out = _open(content, limits), []
    for name, part in _sheet_parts(box):
        for x in _xml(box, part).iter(f"{_S}mergeCell"):
            first, _, last = x.get("ref").partition(":")
            out.append((name, *_place(first), *_place(last or first)))
    return out


#: fixed values: what a slide's shapes are besides text: elements of the drawing, and their names among its features
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_FEATURES = {f"{_P}pic": "picture", f"{_P}cxnSp": "connector", f"{_P}grpSp": "group"}
_NOTES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/notesSlide"


def _paragraphs(shape: ET.Element) -> list[str]:
    marks = {f"{_A}t": lambda x: x.text or "", f"{_A}br": lambda _: "\n", f"{_A}tab": lambda _: "\t"}
    return [text for p in shape.iter(f"{_A}p") if (text := "".join(marks[x.tag](x) for x in p.iter() if x.tag in marks).strip())]


def _shapes(tree: ET.Element, features: set[str]) -> Iterator[str]:
    """Text of a drawing's shapes in its order, groups from inside; tables row by row."""
    for x in tree:
        if x.tag in _FEATURES:
            features.add(_FEATURES[x.tag])
        if x.tag == f"{_P}grpSp":
            yield from _shapes(x, features)
        elif x.tag == f"{_P}sp":
            yield from _paragraphs(x)
        elif x.tag == f"{_P}graphicFrame":
            rows = [[" ".join(_paragraphs(c)) for c in r.iter(f"{_A}tc")] for r in x.iter(f"{_A}tr")]
            features.add("table" if rows else "chart" if any(y.tag.endswith("}chart") for y in x.iter()) else "object")
            yield from ("\t".join(r) for r in rows if any(r))


def _resolve(owner: str, target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(owner), target))


def _relations(box: zipfile.ZipFile, owner: str) -> dict[str, tuple[str, str]]:
    """Kind and part of the internal relationships of a part, by id; the part must be there."""
    folder, name = posixpath.split(owner)
    rels = f"{folder}/_rels/{name}.rels"
    out = {}
    for r in _xml(box, rels) if rels in box.namelist() else ():
        if r.get("TargetMode") != "External":
            part = _resolve(owner, r.get("Target", ""))
            if part not in box.namelist():
                raise Refused("missing-internal-target")
            if r.get("Id") in out:
                raise Refused("ambiguous-relationship")
            out[r.get("Id")] = (r.get("Type", ""), part)
    return out


def pptx_deck(content: bytes, limits: tuple[int, int] = LIMITS) -> list[dict]:
    """The slides in the deck's order: number, slide_id, part, hidden, text, notes (null without) and sorted features."""
    box, main = _open(content, limits), "ppt/presentation.xml"
    relations, out, ids = _relations(box, main), [], set()
    for number, x in enumerate(_xml(box, main).iter(f"{_P}sldId"), 1):
        own, rid = int(x.get("id", 0)), x.get(f"{_R}id")
        if rid not in relations:
            raise Refused("dangling-slide")
        if own in ids or not 256 <= own < 1 << 31:
            raise Refused("invalid-slide-id")
        ids.add(own)
        part, features = relations[rid][1], set()
        slide = _xml(box, part)
        text = [line for tree in slide.iter(f"{_P}spTree") for line in _shapes(tree, features)]
        notes = [line for kind, p in _relations(box, part).values() if kind == _NOTES for tree in _xml(box, p).iter(f"{_P}spTree") for line in _shapes(tree, set())]
        has = any(kind == _NOTES for kind, _ in _relations(box, part).values())
        out.append({"number": number, "slide_id": own, "part": part, "hidden": slide.get("show") in ("0", "false"), "text": "\n".join(text), "notes": "\n".join(notes) if has else None, "features": sorted(features)})
    return out


def pptx_slides(content: bytes, limits: tuple[int, int] = LIMITS) -> list[tuple[int, str]]:
    """(number, text) of the slides in the deck's order; each paragraph and each row of a table is a line."""
    return [(x["number"], x["text"]) for x in pptx_deck(content, limits)]


DECK = T.ArrayType(T.StructType([
    T.StructField("number", T.IntegerType()), T.StructField("slide_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("hidden", T.BooleanType()), T.StructField("text", T.StringType()),
    T.StructField("notes", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())),
]))


def deck(content: Column, limits: tuple[int, int] = LIMITS) -> Column:
    """array of a presentation's slides as ``pptx_deck`` gives them; null for what isn't one."""

    def one(raw: bytes | None) -> list[dict] | None:
        try:
            return pptx_deck(raw, limits) if raw else None
        except (Refused, ET.ParseError, zipfile.BadZipFile, ValueError):
            return None

    slide = pa.struct([("number", pa.int32()), ("slide_id", pa.int64()), ("part", pa.string()), ("hidden", pa.bool_()), ("text", pa.string()), ("notes", pa.string()), ("features", pa.list_(pa.string()))])

    @F.arrow_udf(DECK)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(x.as_py()) for x in batch], pa.list_(slide))

    return run(content)


#: fixed values: the headers of a mail that its mirror shows, and what stands for a body without text
SHOWN_HEADERS, NO_TEXT = ("From", "To", "Cc", "Subject", "Date"), "[no text on this page]"


def mail_parts(content: bytes) -> tuple[dict[str, str], str, bool, list[str]]:
    """Headers, body, whether it comes from HTML, and the attachments' names or else types."""
    m = email.message_from_bytes(content, policy=email.policy.default)
    headers = {k: str(m[k]) for k in SHOWN_HEADERS if m[k]}
    plain, rich = m.get_body(("plain",)), m.get_body(("html",))
    body = plain.get_content() if plain else visible_text(rich.get_content()) or "" if rich else ""
    return headers, body, not plain and rich is not None, [a.get_filename() or a.get_content_type() for a in m.iter_attachments()]


def mail_text(content: bytes) -> str:
    """A table of headers, a note of attachments that aren't converted, and the body as a section."""
    headers, body, _, files = mail_parts(content)
    cell = lambda x: x.replace("|", "\\|").replace("\n", " ").strip()
    table = "".join(f"| {k} | {cell(v)} |\n" for k, v in {"Header": "Value", **headers}.items()).replace("\n", "\n|---|---|\n", 1)
    note = f"\nAttachments (not converted here): {', '.join(map(cell, files))}\n" if files else ""
    return f"{table}{note}\n## Body\n\n{re.sub(r'\r\n?', chr(10), body).strip() or NO_TEXT}"


#: an innermost field of a binary Word file: what it says to do, then perhaps its result
_FIELD = re.compile("\x13[^\x13-\x15]*(?:\x14([^\x13-\x15]*))?\x15")


def word97_plain(text: str) -> str:
    """Main text of a binary Word file: fields keep their results only, cell marks are tabs, paragraph marks line ends."""
    found = 1
    while found:  # from the innermost fields outwards
        text, found = _FIELD.subn(lambda m: m[1] or "", text)
    if re.search("[\x13-\x15]", text):
        raise Refused("unbalanced-field")
    return text.translate({7: "\t", 13: "\n"})


def image_size(content: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF or JPEG from its header."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", content[16:24])
    if content[:4] == b"GIF8":
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            if content[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    raise Refused("not-an-image")


#: fixed values of compound files: what they start with, the end of a chain, and entries of a directory that are streams
_COMPOUND, _LAST_SECTOR, _STREAM = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFA, 2


def compound_streams(content: bytes) -> list[str]:
    """Names of the streams of a compound file (OLE), from its directory; storages aren't named."""
    if content[:8] != _COMPOUND or len(content) < 512:
        raise Refused("not-a-compound-file")
    size = 1 << struct.unpack_from("<H", content, 30)[0]
    first, more, n_more = struct.unpack_from("<I", content, 48)[0], *struct.unpack_from("<II", content, 68)
    sector = lambda k: content[(k + 1) * size : (k + 2) * size]
    tables = list(struct.unpack_from("<109I", content, 76))
    for _ in range(min(n_more, len(content) // size)):
        found = struct.unpack(f"<{size // 4}I", sector(more))
        tables += found[:-1]
        more = found[-1]
    following = [x for k in tables if k < _LAST_SECTOR for x in struct.unpack(f"<{size // 4}I", sector(k).ljust(size, b"\xff"))]
    names, seen = [], set()
    while first < _LAST_SECTOR:
        if first in seen or first >= len(following):
            raise Refused("broken-directory")
        seen.add(first)
        raw = sector(first)
        for at in range(0, len(raw) - 127, 128):
            length, kind = struct.unpack_from("<HB", raw, at + 64)
            if kind == _STREAM and 2 <= length <= 64:
                names.append(raw[at : at + length - 2].decode("utf-16-le", "replace"))
        first = following[first]
    return names


def member_names(content: Column, limits: tuple[int, int] = LIMITS) -> Column:
    """array of the names of a package's parts or a compound file's streams; null for other files and broken ones."""

    def one(raw: bytes | None) -> list[str] | None:
        try:
            if raw and raw[:8] == _COMPOUND:
                return compound_streams(raw)
            return _open(raw, limits).namelist() if raw and raw[:4] == b"PK\x03\x04" else None
        except (Refused, struct.error):
            return None

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(x.as_py()) for x in batch], pa.list_(pa.string()))

    return run(content)


READERS = {
    "docx": docx_text,
    "xlsx": lambda c, limits=LIMITS: "\n".join("\t".join(map(str, x)) for x in xlsx_cells(c, limits)),
    "pptx": lambda c, limits=LIMITS: "\n\n".join(f"## Slide {n}\n\n{t}" for n, t in pptx_slides(c, limits)),
    "eml": lambda c, limits=LIMITS: mail_text(c),
    "word97-text": lambda c, limits=LIMITS: word97_plain(c.decode("utf-16-le")),
    "image": lambda c, limits=LIMITS: "{} x {}".format(*image_size(c)),
}
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("code", T.StringType())])


def read_text(content: Column, kind: Column, limits: tuple[int, int] = LIMITS) -> Column:
    """struct<text, code>: the text that the reader of ``kind`` (READERS) gives, or why there is none."""

    def one(raw: bytes | None, name: str | None) -> tuple[str | None, str | None]:
        if raw is None or name not in READERS:
            return None, "unsupported"
        try:
            return READERS[name](raw, limits), None
        except Refused as fault:
            return None, str(fault)
        except Exception as fault:  # noqa: BLE001  one bad file is one failed row
            return None, f"failed:{type(fault).__name__}"

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, kinds in batches:
            found = [one(c.as_py(), k.as_py()) for c, k in zip(contents, kinds, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], ["text", "code"])

    return run(content, kind)
