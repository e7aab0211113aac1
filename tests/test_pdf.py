"""The PDF reader on generated and hand-made files."""

from __future__ import annotations

import json
import zlib

import pytest

from lodestream.plans.source_queries import as_pdf
from lodestream.sources import files, pdf, pdf_items


def single(content: str, extra: str = "", page: str = "", fonts: str = "/F 4 0 R") -> bytes:
    """One page with a content stream; objects from number 6 on are the caller's. No cross-reference table."""
    font = "4 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding << /Differences [1 /eacute /fi /uni4E2D 65 /B] >> >> endobj"
    return f"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Contents 5 0 R /Resources << /Font << {fonts} >> /XObject << /X 6 0 R >> >> {page} >> endobj\n{font}\n5 0 obj << /Length 0 >> stream\n{content}\nendstream endobj\n{extra}".encode("latin-1")


def found(content: str, **more) -> list[tuple]:
    return [(round(i.x, 3), round(i.y, 3), round(i.width, 3), round(i.height, 3), i.text) for i in pdf_items.items(single(content, **more))]


PAGES = [[(72, 700, "One line"), (72, 682, "Zwei  Wörter (mit) \\ Klammern"), (320, 700, "中文 😀 Ω")], [], [(10.5, 20, "last é page")]]


@pytest.mark.parametrize("packed", [True, False])
def test_generated_files_come_back(packed):
    got = pdf_items.items(as_pdf(PAGES, packed))
    assert [(i.page, i.position, i.x, i.y, i.text) for i in got] == [(p, k, x, 792 - y - 10, t) for p, lines in enumerate(PAGES, 1) for k, (x, y, t) in enumerate(lines)]
    assert [i.width for i in got] == pytest.approx([5 * len(t.encode("utf-16-be")) / 2 for lines in PAGES for *_, t in lines])
    assert pdf.builtin(as_pdf(PAGES, packed)) == [(1, "\n".join(t for *_, t in PAGES[0])), (3, "last é page")]


def test_damaged_tables_are_searched():
    whole = as_pdf(PAGES, False)
    for broken in (whole.replace(b"startxref", b"startxxxx"), whole[: whole.rindex(b"xref\n0")], whole.replace(b"0000000", b"0000001")):
        assert pdf_items.items(broken) == pdf_items.items(whole)
    for number in range(1, 9):  # one wrong entry at a time
        place = b"%010d 00000 n" % whole.index(b"%d 0 obj" % number)
        assert pdf_items.items(whole.replace(place, b"%010d 00000 n" % 3)) == pdf_items.items(whole)
    packed = as_pdf(PAGES, True)
    assert pdf_items.items(packed[: packed.rindex(b"startxref")]) == pdf_items.items(packed)


def test_text_state_and_matrices():
    assert found("BT /F 10 Tf 20 50 Td (ab) Tj ET") == [(20, 40, 12, 10, "ab")]
    assert found("BT /F 10 Tf 2 0 0 2 20 50 Tm (ab) Tj ET") == [(20, 30, 24, 20, "ab")]
    assert found("q 2 0 0 2 5 5 cm BT /F 10 Tf 5 10 Td (ab) Tj ET Q BT /F 10 Tf 0 0 Td (c) Tj ET") == [(15, 55, 24, 20, "ab"), (0, 90, 6, 10, "c")]
    assert found("BT /F 10 Tf 12 TL 20 80 Td (a) Tj T* (b) Tj (c) ' 1 2 (d d) \" ET") == [(20, 10, 6, 10, "a"), (20, 22, 6, 10, "b"), (20, 34, 6, 10, "c"), (20, 46, 25, 10, "d d")]
    assert found("BT /F 10 Tf 50 Tz 2 Tc 0 50 Td (ab) Tj ET") == [(0, 40, 8, 10, "ab")]
    assert found("BT /F 10 Tf 0 50 Td 5 Ts (a) Tj 0 -20 TD (b) Tj T* (c) Tj ET") == [(0, 35, 6, 10, "a"), (0, 55, 6, 10, "b"), (0, 75, 6, 10, "c")]


def test_strings_and_encodings():
    assert found(r"BT /F 10 Tf 0 50 Td (\(a\)\\ (n) \101\1\2\3) Tj ET")[0][4] == r"(a)\ (n) Béfi中"
    assert found("BT /F 10 Tf 0 50 Td <61 62 6> Tj ET")[0][4] == "ab`"
    assert found("BT /F 10 Tf 0 50 Td [(Hel) -20 (lo) -300 (wor) 10 (ld)] TJ ET")[0][4] == "Hello world"
    assert found("BT /F 10 Tf 0 50 Td (no) Tj % comment (x) Tj\n /F#20x 1 Tf ET")[0][4] == "no"


def test_runs_on_a_line_are_joined_and_columns_are_not():
    line = "BT /F 10 Tf 1 0 0 1 0 50 Tm (ab) Tj 1 0 0 1 12 50 Tm (cd) Tj 1 0 0 1 30 50 Tm (ef) Tj 1 0 0 1 120 50 Tm (gh) Tj ET"
    assert [t for *_, t in found(line)] == ["abcd ef", "gh"]


def test_forms_inline_images_and_rotation():
    form = "6 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 10] /Length 0 >> stream\nBT /F 10 Tf 0 0 Td (in form) Tj ET\nendstream endobj"
    assert found("q 1 0 0 1 5 5 cm /X Do Q BI /W 1 /H 1 ID \x00(Tj\x01 EI BT /F 10 Tf 0 50 Td (after) Tj ET", extra=form) == [(15, 75, 42, 10, "in form"), (0, 40, 30, 10, "after")]
    loop = form.replace("BT ", "/X Do BT ")
    assert {t for *_, t in found("/X Do", extra=loop)} == {"in form"}
    assert found("BT /F 10 Tf 0 1 -1 0 50 20 Tm (up) Tj ET", page="/Rotate 90") == [(20, 40, 12, 10, "up")]
    assert found("BT /F 10 Tf -1 0 0 -1 180 50 Tm (turned) Tj ET", page="/Rotate 180") == [(20, 40, 36, 10, "turned")]


def test_filters_and_failures():
    def with_filter(name, data):
        return f"/Filter /{name} /Length {len(data)} >> stream\n".encode() + data

    text = b"BT /F 10 Tf 0 50 Td (filtered) Tj ET"
    import base64

    for name, data in (("FlateDecode", zlib.compress(text)), ("ASCIIHexDecode", text.hex().encode() + b">"), ("ASCII85Decode", base64.a85encode(text) + b"~>")):
        raw = single("CONTENT").replace(b"/Length 0 >> stream\nCONTENT", with_filter(name, data))
        assert [i.text for i in pdf_items.items(raw)] == ["filtered"]
    for bad in (b"", b"%PDF", b"no pdf at all", single("x").replace(b"/Length 0 >>", b"/Filter /Odd >>"), single("BT", extra="trailer << /Root 1 0 R /Encrypt 9 0 R >>")):
        with pytest.raises(ValueError):
            pdf_items.items(bad)


def test_pages_with_columns_boxes_and_failed_files(spark):
    two = [[(72, 700, "left one"), (72, 680, "left two"), (320, 700, "right")], [(400, 700, "right first"), (20, 100, "x")], [(72, 700, "single")], []]
    rows = [("a.pdf", as_pdf(two)), ("b.pdf", b"broken"), ("c.pdf", as_pdf([[(0, 700, "  \t ")]])), ("d.pdf", None)]
    pages, failed = pdf.read_pages(spark.createDataFrame(rows, "path string, content binary"))
    got = {(r.path, r.page): r for r in pages.collect()}
    assert set(got) == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3)}
    assert [got["a.pdf", i].column for i in (1, 2, 3)] == ["left", "right", "single"] and got["a.pdf", 1].text == "left one\nleft two\nright"
    assert json.loads(got["a.pdf", 1].section_bbox) == [72.0, 82.0, 345.0, 112.0] and got["a.pdf", 1].bbox_schema_version == 1
    assert {r.path for r in failed.collect()} == {"b.pdf", "d.pdf"}


def test_files_are_read_without_a_package(spark):
    rows = [("a.pdf", as_pdf(PAGES)), ("b.pdf", b"%PDF-1.4 broken")]
    got = {r.path: r for r in files.read_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert [(p.label, p.text) for p in got["a.pdf"].pages] == [(str(i), t) for i, t in pdf.builtin(as_pdf(PAGES))] and got["b.pdf"].error and got["b.pdf"].text is None


def test_each_code_of_a_font_is_looked_up_once(monkeypatch):
    from lodestream.plans.source_queries import as_pdf
    from lodestream.sources import pdf_items

    calls, of = [], pdf_items.Font._of
    monkeypatch.setattr(pdf_items.Font, "_of", lambda self, c: calls.append(c) or of(self, c))
    found = pdf_items.items(as_pdf([[(72, 700, "abba"), (72, 600, "caba ")], [(72, 700, "ab \u4e00b")]]))
    assert [x.text for x in found] == ["abba", "caba ", "ab \u4e00b"] and [x.width for x in found] == [20, 25, 25]
    assert sorted(calls) == sorted([*map(ord, "abc "), *map(ord, "ab \u4e00")])
