"""Texts out of bytes: encodings, markup, rich text, packages, passages, stems."""

import io
import random
import zipfile

import pytest

from siltstone.functions import extract as x
from siltstone.functions import fixed
from siltstone.functions import passages as p
from siltstone.functions.stems import english, italian, stems


def package(parts):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for n, s in parts.items():
            z.writestr(n, s)
    return f.getvalue()


@pytest.mark.parametrize(("data", "kind"), [
    (b"", "unknown"), (b"plain", "ascii"), ("é".encode(), "utf8"), (b"\xef\xbb\xbfx", "utf8"), (b"caf\xe9", "legacy"), (b"a\0b\0c\0d\0", "utf16le"), (b"\0a\0b\0c\0d", "utf16be"),
    (b"abc\0defghijklmnopqrst", "binary"), (b"\x01\x02abc", "binary"), (b"a" * 8191 + "é".encode() + b"a", "utf8"), (b"abc" + "é".encode()[:1], "legacy"), (b"\xff\xfea\0", "utf16le")])
def test_encodings(data, kind):
    assert x.detect_encoding(data) == kind


def test_decoding():
    assert x.decoded(b"caf\xe9 \x80") == "café €" and x.decoded("\ufeffhé".encode("utf-16-le")) == "hé" and x.decoded(b"abc\0defghijklmnopqrst") is None
    assert x.tidy(" a \t b\r\n\r\n\n c\xa0\xa0d \n e\x01\ufeff\n") == "a b\n\nc d\ne"


@pytest.mark.parametrize(("html", "text"), [
    ("<p>One<p>Two<b>bold</b>end", "One\nTwo bold end"), ("a<!-- x <p> -->b", "ab"), ("<script>var a='<p>'</script>x<STYLE>y</style>z", "x z"), ("x<script>lost", "x lost"),
    ("caff&egrave; &#8364;&#x41; &nope; &amp;&lt; A & B &unended", "caffè €A   &< A & B &unended"), ("", ""), ("<td>1</td><td>2</td>", "1\n2\n"), ("no < tag", "no ")])
def test_html(html, text):
    assert x.html_text(html) == text


def test_simple_markup_and_charsets():
    assert x.strip_markup("<b>Fattura</b>2026 &amp; <svg>x</svg>y &egrave;") == "Fattura 2026 & y &egrave;"
    assert [x.html_charset(b) for b in (b'<meta charset="ISO-8859-1">', b"charset=windows-1251;", b"charset = 'odd'", b"", b" " * 1100 + b"charset=latin1")] == ["latin-1", "cp1251", "utf-8", "utf-8", "utf-8"]
    assert x.html_file(b'<meta charset="latin1"><p>caf\xe9') == "café"


@pytest.mark.parametrize(("rtf", "text"), [
    (rb"{\rtf1\ansi Hello\par World\tab x}", "Hello\nWorld x"), (rb"{\rtf1{\fonttbl{\f0 Arial;}}text{\*\odd gone}more}", "textmore"), (rb"{\rtf1\ansicpg1252 caf\'e9 \u8364?uro}", "café €uro"),
    (rb"{\rtf1\uc2\u233??x{\uc0\u233 y}}", "éxéy"), (rb"{\rtf1 a\~b\_c\-d\{e\}\\f}", "a b-cd{e}\\f"), (b"{\\rtf1 a\r\nb\\u-10179?\\u-8704?}", "ab\U0001f600"), (rb"{\rtf1\fromhtml1 <b>x</b>y}", "x y")])
def test_rich_text(rtf, text):
    assert x.rtf_text(rtf).strip() == text


def test_packages():
    word = package({"word/document.xml": "<w:d xmlns:w='w'><w:p><w:t>One</w:t></w:p><w:p><w:t>T&amp;wo</w:t><w:instrText>code</w:instrText></w:p></w:d>", "word/header2.xml": "<w:h xmlns:w='w'><w:p><w:t>head</w:t></w:p></w:h>"})
    assert x.office_text(word) == ("ok", "One\nT&wo\nhead\n")
    slides = package({f"ppt/slides/slide{i}.xml": f"<p xmlns:a='a'><a:p><a:t>s{i}</a:t></a:p></p>" for i in (10, 2, 1)})
    assert x.office_text(slides) == ("ok", "s1\ns2\ns10\n")
    assert x.office_text(package({"xl/sharedStrings.xml": "<s><si><t>a_x000D_b</t></si><si><t>c</t></si></s>"})) == ("ok", "a\rb\nc\n")
    assert x.office_text(package({"content.xml": "<o xmlns:text='t'><text:p>one <text:span>two</text:span></text:p>out<text:h>h</text:h></o>"})) == ("ok", "one two\nh\n")
    assert x.office_text(package({"other": "x"})) == ("failed", "") and x.office_text(b"no zip") == ("failed", "") and x.office_text(bytes.fromhex("D0CF11E0A1B11AE1")) == ("encrypted", "")
    assert x.office_text(package({"word/document.xml": ""})) == ("empty", "")
    book = package({"c10.xhtml": "<p>ten", "c2.html": "<p>two", "nav.xhtml": "<p>no", "x.css": "p"})
    assert x.epub_text(book) == "two\nten\n"
    assert x._part(zipfile.ZipFile(io.BytesIO(b := package({"a": b"\0" * (4 << 20)}))), zipfile.ZipFile(io.BytesIO(b)).infolist()[0]) == b""
    mail = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>caf=E9</p>\r\n--b--\r\n"
    assert x.extract(3, mail) == ("ok", "café")


@pytest.mark.parametrize(("kind", "data", "status"), [(1, b"x", "ok"), (1, None, "empty"), (1, b"", "empty"), (1, b"\1\2\3", "failed"), (4, b"%PDF-", "unavailable"), (6, b"x", "unavailable"), (5, b"x", "failed"), (8, b"x", "empty"), (9, b"PK\x03\x04broken", "empty"), (None, b"x", "ok"), (3, b"<p> </p>", "empty")])
def test_statuses(kind, data, status):
    assert x.extract(kind, data)[0] == status


def test_broken_files_do_not_take_a_batch_with_them(spark):
    f = spark.createDataFrame([(1, 5, bytearray(b"PK\x03\x04")), (2, 1, bytearray(b"fine")), (3, None, None)], "id int, kind int, content binary")
    assert sorted(map(tuple, x.extracted(f, "id", "kind", "content").collect()), key=str) == [(1, "failed", None), (2, "ok", "fine"), (3, "empty", None)]


def test_passages_cover_and_stay_in_budget():
    rng = random.Random(1)
    for sample in ["word. " * 3000, "3.14 " * 3000, "x" * 20000, "è così " * 3000, "中文" * 4000, "😀" * 4000, "a\n\nb c; " * 3000, "".join(rng.choice("ab .\né中😀1{") for _ in range(20000))]:
        raw, at = sample.encode(), 0
        cuts = p.passages(sample)
        assert cuts[0][0] == 0 and sum(cuts[-1]) == len(raw) and len(cuts) > 1
        for i, (o, n) in enumerate(cuts):
            part = raw[o : o + n].decode()  # no character is cut
            units = sum(int(p.WEIGHT[c.encode()[0]]) for c in part)
            assert o <= at < o + n and units <= fixed.CHUNK_TOKENS * fixed.UNITS_A_TOKEN + 24
            assert i == 0 or at - o <= fixed.CHUNK_OVERLAP + 3
            at = o + n
    assert p.passages("") == [] and p.passages("short") == [(0, 5)]


def test_previews_and_marks():
    text = "alpha " * 60 + "the needle here " + "omega " * 60
    s = p.snippet(text, 0, len(text), ["needle"])
    assert s.startswith("… ") and s.endswith(" …") and "needle" in s and len(s.encode()) < 260
    assert p.snippet("short\ntext", 0, 10, ["zzz"]) == "short text" and p.snippet("", 5, 3, []) == ""
    assert p.highlight("A <b> abba", "ab bba") == "A &lt;b&gt; <mark>ab</mark>ba" and p.highlight("x", "") == "x"
    assert p.identifier_parts("ItemBlocking user_profile __init__ plain x_y HTTPServer2Go") == ["item", "blocking", "user", "profile", "init", "httpserver2", "go"]


def test_stems():
    for word, stem in {"consistency": "consist", "knackeries": "knackeri", "generously": "generous", "happy": "happi", "hopping": "hop", "hoping": "hope", "skies": "sky", "communication": "communic", "cries": "cri", "ties": "tie", "gas": "gas"}.items():
        assert english(word) == stem
    for word, stem in {"abbandonata": "abbandon", "abbandonerà": "abbandon", "pronunciamento": "pronunc", "propizio": "propiz", "contratti": "contratt", "nazioni": "nazion", "amiche": "amic"}.items():
        assert italian(word) == stem
    assert stems("contratti") == ["contratt"] and stems("abc") == stems("user_name") == stems("abc123") == []
