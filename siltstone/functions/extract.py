"""Text out of the bytes of files: encodings, markup, rich text, office packages, books.

Plain Python on one file at a time, made to be run in Arrow batches by ``extracted``; whole texts come out, without a cap.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.entities import name2codepoint
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.functions import fixed

# fixed values: entities by name (their characters are HTML's), and the names beyond HTML's own
ENTITIES = (
    "amp lt gt quot apos nbsp agrave egrave eacute igrave ograve ugrave Agrave Egrave Eacute Igrave Ograve Ugrave agr aacute acirc auml aring ccedil ecirc euml iacute icirc iuml ntilde oacute ocirc otilde ouml uacute ucirc uuml "
    "szlig copy reg trade euro pound deg middot laquo raquo ldquo rdquo lsquo rsquo ndash mdash hellip bull dagger permil sect para plusmn times divide frac12 frac14 sup2 sup3 ordm ordf iexcl iquest cent yen curren"
).split()
ENTITY = {n: chr({"apos": 39, "agr": 0xE0}.get(n) or name2codepoint[n]) for n in ENTITIES}
# fixed values: elements that break a line, and elements whose content is no text
BLOCKS = frozenset("p div br li tr td th h1 h2 h3 h4 h5 h6 section article header footer blockquote pre table ul ol dl dt dd hr form nav aside main".split())
OPAQUE = ("script", "style", "noscript", "template", "svg")
SIMPLE_OPAQUE = ("script", "style", "svg")
SIMPLE_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}
# fixed values: declared character sets and their codecs
CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "iso-8859-1": "latin-1", "latin1": "latin-1", "windows-1252": "cp1252", "cp1252": "cp1252", "windows-1251": "cp1251", "iso-8859-15": "iso8859-15", "utf-16": "utf-16-le", "utf-16le": "utf-16-le"}
# fixed values: destinations of rich text that hold no text
RTF_SKIPPED = frozenset((
    "fonttbl colortbl stylesheet listtable listoverridetable rsidtbl generator filetbl revtbl themedata datastore latentstyles info pict object objdata xmlnstbl mmathPr wgrffmtfilter pnseclvl colorschememapping "
    "template operator company userprops svb bkmkstart bkmkend field falt panose atnid atnauthor").split())
# fixed values: parts of office packages, and their elements of text, of no text, and that break
PACKAGES = {
    "word": (r"word/(document|footnotes|endnotes|comments)\.xml|word/(header|footer).*", {"w:t"}, {"w:instrText", "w:delText"}, {"w:p", "w:br", "w:tab", "w:tc"}),
    "slides": (r"ppt/(slides/slide|notesSlides/notesSlide).*\.xml", {"a:t"}, set(), {"a:p", "a:br"}),
    "excel": (r"xl/sharedStrings\.xml|xl/worksheets/sheet.*\.xml", {"t"}, set(), {"si", "c", "row"}),
    "open": (r"content\.xml", {"text:p", "text:h"}, set(), {"text:p", "text:h", "text:line-break", "table:table-cell"}),
}
PACKAGE_MARKS = [("word", re.compile(r"word/document\.xml\Z")), ("slides", re.compile("ppt/slides/")), ("excel", re.compile("xl/")), ("open", re.compile(r"content\.xml\Z"))]
MOST_ENTRIES, MOST_PART, MOST_RATIO, RATIO_FROM = 20_000, 64 << 20, 200, 1 << 20


# -- encodings ----------------------------------------------------------------------------------------
def detect_encoding(data: bytes) -> str:
    """utf8, utf16le, utf16be, binary, ascii, legacy or unknown (nothing to look at), by the signature or the first bytes."""
    if not data:
        return "unknown"
    for mark, name in ((b"\xef\xbb\xbf", "utf8"), (b"\xff\xfe", "utf16le"), (b"\xfe\xff", "utf16be")):
        if data.startswith(mark):
            return name
    head = data[: fixed.SNIFF_BYTES]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if even + odd:
        if even + odd <= len(head) // 8:
            return "binary"
        return "utf16le" if odd > 8 * even else "utf16be" if even > 8 * odd else "binary"
    control = sum(head.count(c) for c in range(32) if c not in b"\t\n\r\f")
    if control * 100 > len(head) * 2:
        return "binary"
    if head.isascii():
        return "ascii"
    try:
        head.decode()
    except UnicodeDecodeError as e:
        cut_here = e.reason == "unexpected end of data" and len(head) < len(data)
        return "utf8" if cut_here else "legacy"
    return "utf8"


def decoded(data: bytes) -> str | None:
    """The whole file as text; what is no UTF-8 after all is Windows-1252; None for binary files."""
    kind = detect_encoding(data)
    if kind == "binary":
        return None
    if kind.startswith("utf16"):
        return data.decode("utf-16-" + kind[-2:], "replace").removeprefix("﻿")
    try:
        return data.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


_BLANK = "[ \t\x0b\f\xa0]"
_TIDY = [
    (re.compile("[\x00-\x08\x0e-\x1f\r﻿]"), ""), (re.compile(f"{_BLANK}*\n{_BLANK}*\n[ \t\x0b\f\xa0\n]*"), "\x01"), (re.compile(f"{_BLANK}*\n{_BLANK}*"), "\n"),
    (re.compile(f"{_BLANK}+"), " "), (re.compile("^[ \n\x01]+|[ \n\x01]+\\Z"), ""), (re.compile("\x01"), "\n\n")]


def tidy(text: str) -> str:
    """As functions.text.tidy does it for a column."""
    for pattern, by in _TIDY:
        text = pattern.sub(by, text)
    return text


# -- markup -------------------------------------------------------------------------------------------
class _Out:
    """Text with separators that do not pile up."""

    def __init__(self):
        self.parts: list[str] = []
        self.last = ""

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.last = s[-1]

    def space(self) -> None:
        if self.last and self.last not in " \n":
            self.add(" ")

    def newline(self) -> None:
        if self.last and self.last != "\n":
            self.add("\n")


_ENTITY = re.compile(r"&([^; <&]{1,31});")


def _character(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return ENTITY.get(name, " ")
    digits = name[2:] if name[1:2] in ("x", "X") else name[1:]
    base = 16 if name[1:2] in ("x", "X") else 10
    try:
        code = int(digits, base) if digits.isalnum() and digits.isascii() else 0
    except ValueError:
        code = 0
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([^\s>/]*)[^>]*(?:>|\Z)", re.S)


def _stripped(source: str, opaque: tuple[str, ...], blocks: frozenset[str], entities, comments: bool) -> str:
    out, at = _Out(), 0
    while m := _TAG.search(source, at):
        out.add(entities(source[at : m.start()]))
        at = m.end()
        if m[2] is None and comments:
            continue
        name = (m[2] or "").lower()
        if not m[1] and name in opaque:
            close = re.compile("</" + name, re.I).search(source, m.start())
            if close:
                end = source.find(">", close.start())
                at = len(source) if end < 0 else end + 1
            out.space()
        elif name in blocks:
            out.newline()
        else:
            out.space()
    out.add(entities(source[at:]))
    return "".join(out.parts)


def html_text(source: str) -> str:
    """The text of HTML: block elements break lines, other tags are spaces, scripts and the like go, entities become characters."""
    return _stripped(source, OPAQUE, BLOCKS, lambda s: _ENTITY.sub(_character, s), True)


_SIMPLE = re.compile("|".join(map(re.escape, SIMPLE_ENTITIES)))


def strip_markup(source: str) -> str:
    """A plainer stripping, as for previews: every tag is a space, six entities are known."""
    return _stripped(source, SIMPLE_OPAQUE, frozenset(), lambda s: _SIMPLE.sub(lambda m: SIMPLE_ENTITIES[m[0]], s), False)


def html_charset(data: bytes) -> str:
    """The codec of the character set declared in the first 1,024 bytes; UTF-8 where none is, or an unknown one."""
    m = re.search(rb"charset[ =\"']*([^\"'> ;\r\n]*)", data[:1024], re.I)
    return CHARSETS.get(m[1].decode("latin-1").lower(), "utf-8") if m else "utf-8"


def html_file(data: bytes) -> str:
    codec = html_charset(data)
    return html_text(data.decode(codec, "replace"))


# -- rich text ----------------------------------------------------------------------------------------
_RTF = re.compile(rb"(?P<brace>[{}])|[\r\n]+|\\(?:(?P<star>\*)|(?P<symbol>[\\{}~_-])|'(?P<hex>[0-9A-Fa-f]{2})|(?P<word>[A-Za-z]+)(?P<number>-?\d+)? ?|(?s:.))|(?P<plain>[^\\{}\r\n]+)")
_RTF_BREAKS = {b"par": "\n", b"line": "\n", b"sect": "\n", b"page": "\n", b"row": "\n", b"tab": " ", b"cell": " "}


def rtf_text(data: bytes) -> str | None:
    """The text of rich text; None for other files. Groups of unknown and of textless destinations are left out."""
    if not data.startswith(b"{\\rtf"):
        return None
    out: list[str] = []
    run = bytearray()
    codec, html, stack, skip, fallback, ahead = "cp1252", False, [], False, 1, 0

    def flush() -> None:
        if run:
            out.append(run.decode(codec, "replace"))
            run.clear()

    def put(b: bytes) -> None:
        nonlocal ahead
        if not skip:
            drop = min(ahead, len(b))  # what stands in for a character given by its number
            ahead -= drop
            run.extend(b[drop:])

    for m in _RTF.finditer(data):
        if m["plain"]:
            put(m["plain"])
        elif m["brace"] == b"{":
            stack.append((skip, fallback))
        elif m["brace"]:
            flush()
            if stack:
                skip, fallback = stack.pop()
        elif m["star"]:
            skip = True
        elif m["symbol"]:
            s = m["symbol"]
            if s == b"-" or skip:
                ahead = max(0, ahead - 1) if not skip else ahead
            else:
                put({b"~": b" ", b"_": b"-"}.get(s, s))
        elif m["hex"]:
            put(bytes([int(m["hex"], 16)]))
        elif m["word"]:
            word, number = m["word"], int(m["number"]) if m["number"] else None
            if word == b"ansicpg" and number is not None:
                flush()
                codec = _codec(number)
            elif word == b"fromhtml":
                html = True
            elif word == b"uc" and number is not None:
                fallback = max(0, number)
            elif word == b"u" and number is not None:
                if not skip:
                    flush()
                    code = number + 65536 if number < 0 else number
                    out.append(chr(code) if 0 < code <= 0x10FFFF else "")
                ahead = fallback
            elif word in _RTF_BREAKS:
                if not skip:
                    flush()
                    out.append(_RTF_BREAKS[word])
            elif word.decode() in RTF_SKIPPED:
                skip = True
            else:
                ahead = 0
    flush()
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs of surrogates become one character
    return html_text(text) if html else text


def _codec(page: int) -> str:
    import codecs

    name = {65001: "utf-8", 10000: "mac_roman"}.get(page, f"cp{page}")
    try:
        return codecs.lookup(name).name
    except LookupError:
        return "cp1252"


# -- packages -----------------------------------------------------------------------------------------
def natural_key(name: str) -> list:
    """Numbers inside a name by their value: slide2 before slide10."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", name)]


def _open(data: bytes) -> zipfile.ZipFile | None:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return None
    return z if len(z.infolist()) <= MOST_ENTRIES else None


def _part(z: zipfile.ZipFile, entry: zipfile.ZipInfo) -> bytes:
    """A part's bytes; none for broken ones, for those too large, and for those that swell suspiciously."""
    if entry.file_size > MOST_PART or (entry.file_size > RATIO_FROM and entry.file_size > MOST_RATIO * max(entry.compress_size, 1)):
        return b""
    try:
        with z.open(entry) as f:
            return f.read(MOST_PART)
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, RuntimeError, EOFError):
        return b""


def xml_text(data: bytes, texts: set[str], skipped: set[str], breaks: set[str]) -> str:
    """The text inside the elements ``texts`` but not inside ``skipped``; the end of ``breaks`` is a line's end.

    What comes before an error in the XML counts. Entities that the document defines itself are not followed.
    """
    out, depth, held = _Out(), 0, 0

    def start(name, _):
        nonlocal depth, held
        depth += name in texts
        held += name in skipped

    def end(name):
        nonlocal depth, held
        depth -= name in texts
        held -= name in skipped
        if name in breaks:
            out.newline()

    def chars(s):
        if depth and not held:
            out.add(s)

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    p.EntityDeclHandler = lambda *a: p.StopParsing() if hasattr(p, "StopParsing") else None
    try:
        p.Parse(data, True)
    except expat.ExpatError:
        pass
    return "".join(out.parts)


_ESCAPE = re.compile("_x([0-9A-Fa-f]{4})_")


def office_text(data: bytes) -> tuple[str, str]:
    """(status, text) of a word processor's, spreadsheet's or presentation's package; the kind is told by its parts."""
    if data.startswith(bytes.fromhex(fixed.MAGIC["office_legacy"])):
        return "encrypted", ""
    z = _open(data)
    if z is None:
        return "failed", ""
    entries = {e.filename: e for e in z.infolist()}
    kind = next((k for k, mark in PACKAGE_MARKS if any(mark.match(n) for n in entries)), None)
    if kind is None:
        return "failed", ""
    wanted, texts, skipped, breaks = PACKAGES[kind]
    out = _Out()
    for name in sorted((n for n in entries if re.fullmatch(wanted, n)), key=natural_key):
        out.add(xml_text(_part(z, entries[name]), texts, skipped, breaks))
        out.newline()
    text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), "".join(out.parts))
    return ("ok", text) if text else ("empty", "")


def epub_text(data: bytes) -> str | None:
    """The chapters of a book in natural order, without contents and cover pages."""
    z = _open(data)
    if z is None:
        return None
    out = _Out()
    pages = [e for e in z.infolist() if re.search(r"\.(xhtml|html|htm)\Z", e.filename, re.I) and not re.search("nav|toc|cover", e.filename)]
    for e in sorted(pages, key=lambda e: natural_key(e.filename)):
        out.add(html_text(_part(z, e).decode("utf-8", "replace")))
        out.newline()
    return "".join(out.parts) or None


def mhtml_text(data: bytes) -> str:
    """The text and HTML parts of a saved page."""
    from email import message_from_bytes

    parts = []
    for p in message_from_bytes(data).walk():
        if p.get_content_maintype() == "text":
            body = p.get_payload(decode=True) or b""
            codec = CHARSETS.get((p.get_content_charset() or "utf-8").lower(), "utf-8")
            parts.append(html_text(body.decode(codec, "replace")) if p.get_content_subtype() == "html" else body.decode(codec, "replace"))
    return "\n".join(parts)


# -- any file -----------------------------------------------------------------------------------------
def extract(kind: int | None, data: bytes | None) -> tuple[str, str | None]:
    """(status, tidied text) by the file's kind: ok, empty, failed, encrypted or unavailable (no reader for the format).

    Whatever goes wrong inside one file is that file's status.
    """
    if not data:
        return "empty", None
    try:
        if kind in (5, 7):
            status, text = office_text(data)
            if status != "ok":
                return status, None
        elif kind == 3:
            text = mhtml_text(data) if re.match(rb"(?is)(from|mime-version|content-type|subject|date|snapshot[\w-]*):", data[:200]) else html_file(data)
        elif kind == 8:
            text = rtf_text(data)
        elif kind == 9:
            text = epub_text(data)
        elif kind in (4, 6):
            return "unavailable", None
        else:
            text = decoded(data)
            if text is None:
                return "failed", None
        text = tidy(text or "")
        return ("ok", text) if text else ("empty", None)
    except Exception:  # a file that breaks its reader must not take the batch with it
        return "failed", None


def extracted(files: DataFrame, id_col: str, kind_col: str, content_col: str) -> DataFrame:
    """(id, status, text) of files given as (id, kind, binary content), in Arrow batches."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            done = [extract(k, c) for k, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in done], pa.string()), pa.array([t for _, t in done], pa.string())], names=[id_col, "status", "text"])

    return files.select(id_col, kind_col, content_col).mapInArrow(run, f"`{id_col}` {kind}, status string, text string")
