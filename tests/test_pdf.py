import zlib

import pytest

from strataforge.sources import files, pdf

HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def stream(data, info=b"", packed=True):
    data = zlib.compress(data) if packed else data
    return b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (info, b"/Filter /FlateDecode" if packed else b"", len(data), data)


def lines(*placed):
    return b"BT /F1 10 Tf " + b" ".join(b"1 0 0 1 %d %d Tm (%s) Tj" % p for p in placed) + b" ET"


def objects(contents, font=HELVETICA):
    """Catalog, pages tree, font and, for each page, the page and its content."""
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(contents)))
    out = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (kids, len(contents)), font]
    for i, c in enumerate(contents):
        out += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i), c]
    return out


def with_table(objs, trailer=b""):
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objs, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n%strailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (len(objs) + 1, table, len(objs) + 1, trailer, len(out))


def with_streams(objs):
    """Plain objects in an object stream, a cross-reference stream with PNG prediction."""
    inside = [i for i, o in enumerate(objs, 1) if b"stream" not in o]
    head, body = [], b""
    for i in inside:
        head.append(b"%d %d" % (i, len(body)))
        body += objs[i - 1] + b" "
    first = b" ".join(head) + b" "
    holder, ref = len(objs) + 1, len(objs) + 2
    objs = [*objs, stream(first + body, b"/Type /ObjStm /N %d /First %d" % (len(inside), len(first)))]
    out, rows = b"%PDF-1.5\n", {0: (0, 0, 0)}
    for i, o in enumerate(objs, 1):
        if i in inside:
            rows[i] = (2, holder, inside.index(i))
            continue
        rows[i] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    rows[ref] = (1, len(out), 0)
    raw = [bytes([k]) + p.to_bytes(3, "big") + bytes([g]) for _, (k, p, g) in sorted(rows.items())]
    coded, before = b"", bytes(5)
    for r in raw:  # each row as differences to the row above
        coded += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before, strict=True))
        before = r
    x = stream(coded, b"/Type /XRef /W [1 3 1] /Size %d /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 5 >>" % (ref + 1))
    return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (ref, x, len(out))


PAGES = [
    lines((72, 760, b"ACME manual page 1"), (72, 700, b"Reset the hydrau-"), (72, 688, b"lic valve \\(HPV\\) first."), (72, 640, b"Code"), (200, 640, b"Meaning"), (72, 628, b"E-042"), (200, 628, b"Servo fuse")),
    lines((72, 760, b"ACME manual page 2"), (72, 700, b"Second page.")),
    lines((72, 760, b"ACME manual page 3"), (72, 700, b"Third \\251 page.")),
]


@pytest.mark.parametrize("made", [with_table, with_streams, lambda o: with_table(o).replace(b"startxref\n", b"startxref\n9"), lambda o: with_streams(o).rpartition(b"startxref")[0]])
def test_pages_tables_and_headers(spark, made):
    data = made(objects([stream(p) for p in PAGES]))
    got = pdf.pages(data)
    assert got[1] == "ACME manual page 2\n\nSecond page." and got[2].endswith("Third © page.")
    assert got[0].splitlines()[:4] == ["ACME manual page 1", "", "Reset the hydrau-", "lic valve (HPV) first."]
    rows = spark.createDataFrame([("d", "m.pdf", len(data), bytearray(data))], "document_id string, filename string, size long, content binary")
    parsed = files.parse_files(rows).first()
    assert parsed.error is None
    # markers and the running header are lines that repeat on most pages
    assert parsed.text == "\nReset the hydraulic valve (HPV) first.\n\nCode | Meaning\nE-042 | Servo fuse\n\n\nSecond page.\n\n\nThird © page."


def test_fonts_with_character_maps_and_widths():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00C4> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079007A>] endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /DescendantFonts [<< /DW 500 /W [1 [900 900] 16 18 600] >>] /ToUnicode 6 0 R >>"
    content = b"BT /F1 20 Tf 50 500 Td [<00010010> -3000 <0011>] TJ 0 -24 Td <0002> Tj T* <00200021> Tj ET"
    objs = [*objects([stream(content, packed=False)], font), stream(cmap)]
    assert pdf.pages(with_table(objs)) == ["Äa          b\n\U0001f600xyz"]
    differences = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [65 /uni0416 /b 97 /space] >> >>"
    assert pdf.pages(with_table(objects([stream(lines((10, 10, b"ABaC\\212")))], differences))) == ["Жb Cä"]


def test_forms_and_matrices():
    form = stream(b"BT /F1 10 Tf 0 0 Td (inside) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -40]")
    objs = objects([stream(b"q 1 0 0 1 100 700 cm BT /F1 10 Tf (above) Tj ET /X Do Q BT /F1 10 Tf 14 TL 100 600 Td (one) Tj (two) ' ET")])
    objs[1] = objs[1].replace(b"/Font <<", b"/XObject << /X 6 0 R >> /Font <<")
    assert pdf.pages(with_table([*objs, form])) == ["above\n\ninside\n\none\ntwo"]


def test_bad_files():
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.pages(b"plain text")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.pages(with_table(objects([stream(b"")]), b"/Encrypt << /V 1 >>"))
    assert pdf.pages(with_table(objects([stream(b"")]))) == [""]
    for cut in range(40, 700, 60):
        try:
            pdf.pages(with_table(objects([stream(PAGES[0])]))[:cut])
        except Exception as e:  # an error a row, not an endless loop
            assert str(e) or type(e)


def test_documents_are_dealt_out_before_they_are_printed(spark):
    from strataforge.plans import files

    assert files.pdf_round_trip(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8
