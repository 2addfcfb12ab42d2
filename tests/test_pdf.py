"""PDF kernels without Spark: hand vectors, round trips, corruption."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators.content import Op, parse_content, write_content
from leafmill.operators.fonts import cmap
from leafmill.operators.render import from_png, png, render_page
from leafmill.operators.text import page_spans, page_text, search_spans
from leafmill.sources import ccitt, codecs, files, jpeg, security
from leafmill.sources.document import Document, decode_text, encode_text
from leafmill.sources.syntax import Name, Ref, Str, Stream, SyntaxFault, number, parse_object


def made(text="Hello World\nSecond line", **kw):
    doc = Document()
    page = doc.add_page()
    doc.add_text(page, text, 72, 720, **kw)
    return doc


def read(doc):
    return Document.read(doc.write())


# --- syntax


@pytest.mark.parametrize("raw, value", [(b".5", 0.5), (b"4.", 4.0), (b"-.7", -0.7), (b"+3", 3), (b"9223372036854775808", 9.223372036854775808e18), (b"-12", -12)])
def test_numbers(raw, value):
    got = number(raw)
    assert got == value and type(got) is type(value)


def test_bad_number():
    with pytest.raises(SyntaxFault):
        parse_object(b"1.2.3")


def test_objects():
    v, _ = parse_object(b"<< /A#20B [1 0 R (a\\(b\\)\\101\\\r\nc(d)) <4 1 5> null true -1.5] /C << /D /E >> >>")
    assert v == {"A B": [Ref(1, 0), b"a(b)Ac(d)", b"AP", None, True, -1.5], "C": {"D": "E"}}
    assert parse_object(b"(open")[0] == b"open" and parse_object(b"7 0 R")[0] == Ref(7, 0)


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.binary(max_size=12).map(Str) | st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=6).map(Name) | st.builds(Ref, st.integers(1, 99), st.integers(0, 3)),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=4).map(Name), x, max_size=3), max_leaves=8,
)


@given(VALUES)
@settings(max_examples=300, deadline=None)
def test_written_objects_read_back(v):
    assert parse_object(files.write_object(v) + b" ")[0] == v


def test_reals():
    assert [files.format_real(x) for x in (1.0, 0.1, -0.0000001, 1e20, float("nan"), 2.50, 1e14)] == ["1", "0.1", "0", "100000000000000000000.000000".rstrip("0").rstrip("."), "0", "2.5", "100000000000000"]


# --- filters


def test_filters():
    data = bytes(range(256)) * 3
    assert codecs.flate(zlib.compress(data)) == data == codecs.flate(zlib.compress(data)[2:-4]) == codecs.flate(codecs.flate_stored(data))
    assert codecs.ascii_hex(b"48 65 6C6>zz") == b"Hel`" and codecs.ascii_85(b"<~87cURDZ~>") == b"Hello" and codecs.ascii_85(b"z~>") == b"\0" * 4
    assert codecs.run_length(b"\x02abc\xfed\x80x") == b"abcddd"
    assert codecs.lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    for bad in (lambda: codecs.ascii_85(b"8~>"), lambda: codecs.lzw(b"\xff\xff\xff"), lambda: codecs.flate(b"\x78\x9c\xff"), lambda: codecs.decode_stream(Stream({Name("Filter"): Name("JPXDecode")}, b""))):
        with pytest.raises(codecs.FilterFault):
            bad()
    s = Stream({Name("Filter"): [Name("AHx"), Name("Fl")]}, zlib.compress(b"two").hex().encode() + b">")
    assert codecs.decode_stream(s) == b"two"


def _png_encode(rows, step):
    out, above = b"", np.zeros(len(rows[0]), np.int64)
    for k, row in enumerate(rows):
        row = row.astype(np.int64)
        left = np.concatenate([np.zeros(step, np.int64), row[:-step]])
        corner = np.concatenate([np.zeros(step, np.int64), above[:-step]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][k % 5]
        out += bytes([k % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    return out


def test_predictors():
    rows = np.random.default_rng(1).integers(0, 256, (10, 12)).astype(np.uint8)
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    assert codecs.predict(_png_encode(rows, 3), parms) == rows.tobytes()
    tiff = rows.reshape(10, 4, 3).copy()
    tiff[:, 1:] -= rows.reshape(10, 4, 3)[:, :-1]
    assert codecs.predict(tiff.tobytes(), {**parms, "Predictor": 2}) == rows.tobytes()


def _bits(text):
    text = text.replace(" ", "")
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@pytest.mark.parametrize("code, k, rows, want", [("001 00110101 000101", -1, 1, "00"), ("001 1100 10 000000000001000000000001", -1, 1, "f8"), ("1100 10", 0, 1, "f8"), ("001 1100 10 111", -1, 2, "f8f8"), ("000000000001 1100 10 000000000001 1100 10", 0, 2, "f8f8")])
def test_fax_rows(code, k, rows, want):
    assert ccitt.decode(_bits(code), {"K": k, "Columns": 8, "Rows": rows}).hex() == want
    assert ccitt.decode(_bits(code), {"K": k, "Columns": 8, "Rows": rows, "BlackIs1": True}) == bytes(255 - b for b in bytes.fromhex(want))


def test_fax_tables_are_prefix_codes():
    for table in ccitt._RUNS:
        codes = sorted(table)
        assert len(codes) == 104 and not any(b.startswith(a) for a, b in zip(codes, codes[1:]))


# --- JPEG: a small baseline encoder of our own makes the input


def _jpeg(px, quality=1):
    """Grey baseline file with one flat quantisation and code tables that hold every symbol at 8 bits."""
    h, w = px.shape
    dc, ac = list(range(12)), [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    seg = lambda m, b: b"\xff" + bytes([m]) + (len(b) + 2).to_bytes(2, "big") + b
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([quality] * 64)) + seg(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\0")
    out += seg(0xC4, b"\0" + bytes([0, 0, 0, 0, 12, *[0] * 11]) + bytes(dc)) + seg(0xC4, b"\x10" + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac)) + seg(0xDA, b"\x01\x01\0\0\x3f\0")
    bits, pred = "", 0

    def value(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    for y in range(0, h, 8):
        for x in range(0, w, 8):
            block = px[y : y + 8, x : x + 8].astype(float) - 128
            coef = np.rint(jpeg.BASIS.T @ block @ jpeg.BASIS / quality).astype(int).reshape(-1)[jpeg.ZIGZAG]
            n, v = value(int(coef[0]) - pred)
            pred = int(coef[0])
            bits += format(dc.index(n), "05b") + v
            run = 0
            for c in coef[1:]:
                if not c:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + format(1, "08b"), run - 16
                n, v = value(int(c))
                bits, run = bits + format(ac.index(run << 4 | n), "08b") + v, 0
            bits += format(0, "08b") if run else ""
    bits += "1" * (-len(bits) % 8)
    return out + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_jpeg_and_its_corruption():
    y, x = np.mgrid[0:16, 0:24]
    px = (x * 7 + y * 5 + 20).astype(np.uint8)
    raw = _jpeg(px)
    got = jpeg.decode_jpeg(raw)[..., 0].astype(int)
    assert np.abs(got - px).max() <= 2 and np.abs(got - px).mean() < 1
    rng = random.Random(7)
    for _ in range(80):
        bad = bytearray(raw)
        for _ in range(rng.randrange(1, 9)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            jpeg.decode_jpeg(bytes(bad[: rng.randrange(2, len(bad))]))
        except codecs.FilterFault:
            pass


# --- files


def test_round_trip_and_stable_saves():
    doc = made()
    doc.set_info("Title", "Tëst 日本")
    raw = doc.write()
    back = Document.read(raw)
    assert back.write() == raw and back.info("Title") == "Tëst 日本" and len(back.pages()) == 1
    assert page_text(back, back.page(0)) == "Hello World\nSecond line"


def test_broken_start_and_dangling_encrypt():
    raw = made("survivor").write()
    at = raw.rindex(b"startxref\n") + 10
    doc = Document.read(raw[:at] + b"9999999\n%%EOF\n")
    assert page_text(doc, doc.page(0)) == "survivor"
    doc = Document.read(raw.replace(b"/Size", b"/Encrypt 99 0 R /Size"))
    assert len(doc.pages()) == 1
    with pytest.raises(files.FileFault):
        Document.read(b"no header")


def test_object_and_xref_streams():
    content = b"BT /F1 24 Tf 72 700 Td (Modern) Tj ET"
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents 5 0 R/Resources<</Font<</F1<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>>>>>>>"]
    offs, body = [], b""
    for x in inner:
        offs.append(len(body))
        body += x + b" "
    head = b" ".join(b"%d %d" % (i + 1, o) for i, o in enumerate(offs)) + b" "
    out, place = b"%PDF-1.5\n", {}
    for num, d, data in ((4, b"/Type/ObjStm/N 3/First %d" % len(head), head + body), (5, b"", content)):
        place[num] = len(out)
        out += b"%d 0 obj\n<<%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (num, d, len(data), data)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, place[4], 0), (1, place[5], 0), (1, len(out), 0)]
    table = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in rows)
    start = len(out)
    out += b"6 0 obj\n<</Type/XRef/Size 7/W[1 4 2]/Root 1 0 R/Length %d>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, start)
    doc = Document.read(out)
    assert doc.version == "1.5" and len(doc.pages()) == 1 and "Modern" in page_text(doc, doc.page(0))
    assert not any(isinstance(o, Stream) and o.dict.get("Type") in ("XRef", "ObjStm") for o in doc.objects.values())


def test_newest_section_wins():
    first = made("old").write()
    doc = Document.read(first)
    ref = next(r for r, o in doc.objects.items() if isinstance(o, Stream))
    start = len(first)
    new = b"%d 0 obj\n<</Length 40>>\nstream\nBT /F1 12 Tf 72 720 Td (brand new) Tj ET\nendstream\nendobj\n" % ref.num
    prev = files.start_of_xref(first)
    tail = b"xref\n%d 1\n%010d 00000 n \ntrailer\n<</Size 9/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (ref.num, start, prev, start + len(new))
    doc = Document.read(first + new + tail)
    assert page_text(doc, doc.page(0)) == "brand new"


def test_corruption_never_raises_anything_else():
    raw, rng = made("some text to break\nwith lines").write(), random.Random(5)
    for _ in range(150):
        bad = bytearray(raw)
        for _ in range(rng.randrange(1, 12)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            doc = Document.read(bytes(bad))
            for p in doc.pages():
                page_text(doc, p)
        except (files.FileFault, codecs.FilterFault):
            pass


# --- text and search


def test_text_rules():
    doc = made()
    page = doc.page(0)
    doc.own_resources(page, "Font")
    doc.get(page).pop("Contents")
    doc.append_content(page, b"BT /F1 12 Tf [(Hel) -20 (lo) -250 (world)] TJ 0 -14 Td (next) Tj T* (third) Tj ET BT (after) Tj ET")
    assert page_text(doc, page) == "Hello world\nnext\nthird\nafter"


def test_search_boxes():
    doc = read(made())
    spans = page_spans(doc, doc.page(0))
    count = lambda q, ci=False: [len(h) for h in search_spans(spans, q, ci)]
    assert count("World") == [1] and count("World Second") == [2] and count("world") == [] and count("world", True) == [1] and count("") == []
    x0, y0, x1, y1 = search_spans(spans, "World")[0][0]
    assert 72 < x0 < x1 < 140 and y0 < 720 < y1 and "".join(t for t, _ in spans[0].glyphs) == spans[0].text


def test_glyph_columns_are_the_rows():
    """Glyphs as Arrow columns, beside plain rows, none at all and null."""
    import pyarrow as pa

    from leafmill.operators.text import Glyphs

    doc = made("Hé (llo) \u20ac\nx")
    doc.append_content(doc.page(0), b"BT /F1 9 Tf 1 .2 -.3 1 50 60 Tm (turned) Tj ET")
    spans = page_spans(doc, doc.page(0))
    box = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
    kind = pa.list_(pa.field("element", pa.struct([("text", pa.string()), ("bbox", box)])))
    column = [spans[0].held, None, spans[2].held, [], spans[1].held]
    assert isinstance(spans[0].held, Glyphs) and isinstance(spans[2].held, list)
    want = [None if g is None else [{"text": t, "bbox": dict(zip(("x0", "y0", "x1", "y1"), b))} for t, b in (g.rows() if isinstance(g, Glyphs) else g)] for g in column]
    assert Glyphs.arrow(column, kind).to_pylist() == want and Glyphs.arrow([None, spans[0].held], kind).to_pylist() == [None, want[0]]
    assert [g["bbox"]["x0"] for g in want[0]] == sorted(g["bbox"]["x0"] for g in want[0]) and len(want[0]) == len("Hé (llo) €")


def test_marks_are_no_loop_of_bytes():
    def plain(data, h=0xCBF29CE484222325):
        for c in data:
            h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h

    for n in (0, 1, 767, 768, 769, 1001, 16383, 16384, 16391, 40000):
        data = random.Random(n).randbytes(n)
        assert files.fnv1a64(data) == plain(data) and files.fnv1a64(data, 2**63 + 12345) == plain(data, 2**63 + 12345)
    data, t0 = random.Random(0).randbytes(2_000_000), time.process_time()
    a, t1 = plain(data), time.process_time()
    assert files.fnv1a64(data) == a and (time.process_time() - t1) * 2 < t1 - t0


def test_many_pages_are_added_and_linked_in_one_pass():
    doc, began = Document(), time.process_time()
    link = doc.add({Name("Subtype"): Name("Link"), Name("Rect"): [0, 0, 1, 1], Name("A"): {Name("S"): Name("URI"), Name("URI"): Str(b"u")}})
    for _ in range(20_000):
        doc.objects[doc.add_page()][Name("Annots")] = [link]
    numbers = doc.page_numbers()
    assert sum(len(doc.links(p, numbers)) for p in doc.pages()) == 20_000 and time.process_time() - began < 8
    doc.remove_page(19_999)
    doc.objects[Ref(30_000, 0)] = None
    assert doc.add(1) == Ref(30_001, 0) and doc.add(1) == Ref(30_002, 0)


def _lzw(data: bytes) -> bytes:
    """LZW with all code widths, clear codes where the table is nearly full."""
    table, width, parts, held = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    for c in data:
        x = held + bytes([c])
        if x in table:
            held = x
            continue
        parts.append((table[held], width))
        table[x] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n > 4090:
            parts.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        held = bytes([c])
    bits = "".join(format(v, f"0{w}b") for v, w in [*parts, *([(table[held], width)] if held else []), (257, width)])
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")


def test_codecs_are_no_loop_of_bytes():
    """LZW of every width, PNG rows of every filter in any order, and both of 2 MB."""
    from leafmill.plans.codec_queries import _PNG, lzw_literals, png_rows

    r = random.Random(3)
    for n in (0, 1, 250, 251, 1000, 40_000):
        data = bytes(r.choice(b"abcd e") for _ in range(n))
        assert codecs.lzw(_lzw(data)) == data == codecs.lzw(lzw_literals(data)) and codecs.predict(png_rows(data), _PNG)[:n] == data
    for step, columns in ((1, 5), (3, 4), (2, 1)):
        width = step * columns
        rows, raw, coded = [0] * width, b"", b""
        for _ in range(60):
            how, row = r.randrange(5), [r.randrange(256) for _ in range(width)]
            coded += bytes([how])
            for i, v in enumerate(row):
                a, b, c = (row[i - step] if i >= step else 0), rows[i], (rows[i - step] if i >= step else 0)
                p = a + b - c
                guess = (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[how]
                coded += bytes([(v - guess) % 256])
            rows, raw = row, raw + bytes(row)
        assert codecs.predict(coded, {"Predictor": 15, "Colors": step, "Columns": columns}) == raw
    data, began = r.randbytes(1_000_000), time.process_time()
    assert codecs.lzw(lzw_literals(data)) == data and codecs.predict(png_rows(data), _PNG)[: len(data)] == data
    assert time.process_time() - began < 2


def test_programs_on_columns_agree_with_the_machine():
    from leafmill.operators.colorspaces import run_calculator, run_calculator_columns

    r, words = random.Random(4), ["add", "sub", "mul", "div", "mod", "idiv", "round", "floor", "ceiling", "cvi", "neg", "abs", "sqrt", "sin", "gt", "eq", "exch", "dup", "pop", "1", "-2.5", "0", "3", "true", "2 copy", "index", "copy", "2 1 roll", "roll", "{ neg } if", "{ 2 mul dup } { pop } ifelse", "{ dup 0 gt { 1 add } if } if"]
    for _ in range(400):
        text = "{ " + " ".join(r.choice(words) for _ in range(r.randrange(1, 14))) + " }"
        rows = [(r.choice([0.0, 1.0, 2.0, -1.5, 0.25, 1e300, -7.0]), r.choice([0.0, 1.0, 2.0, 3.0, -2.0, 0.05])) for _ in range(12)]
        try:
            want = [[*run_calculator(text, list(row)), 0.0, 0.0, 0.0][:3] for row in rows]
        except (ValueError, OverflowError):
            with pytest.raises((ValueError, OverflowError)):
                run_calculator_columns(text, [np.array(x) for x in zip(*rows)], 3)
            continue
        assert repr(run_calculator_columns(text, [np.array(x) for x in zip(*rows)], 3).tolist()) == repr(want), text
    deep, n = "{ 100 mul round 3 mod 7 exch 9 exch index 4 1 roll pop pop pop }", 1_000_000
    began = time.process_time()
    got = run_calculator_columns(deep, [np.full(n, 0.04), np.arange(n) % 9 / 100], 1)[:, 0]
    assert got[:3].tolist() == [9.0, 7.0, 0.04] and time.process_time() - began < 4


def test_cmap():
    got = cmap(b"2 beginbfchar <0041> <0058> <0042> <D83DDE00> endbfchar 2 beginbfrange <0050> <0052> <0061> <0060> <0061> [<0031> <0032>] endbfrange")
    assert got == {0x41: "X", 0x42: "😀", 0x50: "a", 0x51: "b", 0x52: "c", 0x60: "1", 0x61: "2"}


def test_content_round_trip():
    raw = b"q 1 0 0 1 5 5 cm /F1 12 Tf (a) Tj [(b) -3 <41>] TJ BI /W 2 /H 1 /CS /G /BPC 8 ID \x00E EI Q"
    ops = parse_content(raw)
    assert [o.operator for o in ops] == ["q", "cm", "Tf", "Tj", "TJ", "BI", "Q"] and ops[5].operands[1] == b"\x00E"
    assert parse_content(write_content(ops)) == ops
    assert [o.operator for o in parse_content(b"1 2 m >> ) 3 4 l S")] == ["m", "l", "S"]


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_text_strings(text):
    assert decode_text(encode_text(text)) == text


# --- editing and navigation


def test_pages_are_edited():
    doc = Document()
    for i in range(3):
        doc.add_text(doc.add_page(), f"page {i}", 72, 700)
    doc.remove_page(1)
    for _ in range(4):
        doc.rotate_page(0, 90)
    doc.rotate_page(1, -90)
    back = read(doc)
    assert [page_text(back, p) for p in back.pages()] == ["page 0", "page 2"] and [back.rotation(p) for p in back.pages()] == [0, 270]
    assert back.size(back.page(1)) == (792, 612) and back.catalog["Pages"] and back.get(back.catalog["Pages"])["Count"] == 2
    with pytest.raises(files.FileFault):
        doc.page(5)
    with pytest.raises(ValueError):
        doc.rotate_page(0, 45)
    page = doc.page(0)
    assert doc.font(page, "Helvetica") == "F1" and doc.font(page, "Courier") == "F2"


# --- security


def test_ciphers():
    key = bytes(range(16))
    assert security.Aes(key).encrypt_block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert security.Aes(bytes(range(32))).encrypt_block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for n in (0, 1, 15, 16, 33):
        assert security.aes_open(key, security.aes_seal(key, b"x" * n, bytes(16))) == b"x" * n
    assert security.aes_open(key, b"short") == b"short"


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 48, 1000])
def test_library_ciphers_agree_with_the_plain_ones(n):
    data, iv = random.Random(n).randbytes(n), bytes(range(16))
    for size in (5, 16, 24, 32):
        key = random.Random(size).randbytes(size)
        assert security.rc4(key, data) == security.plain_rc4(key, data)
        if size > 5:
            whole = data[: n // 16 * 16]
            assert security.cbc_encrypt(key, whole, iv) == security.plain_cbc_encrypt(key, whole, iv)
            assert security.cbc_decrypt(key, data, iv) == security.plain_cbc_decrypt(key, data, iv)


def test_ciphers_are_no_loop_of_bytes():
    data, began = bytes(4_000_000), time.process_time()
    assert security.rc4(b"0123456789abcdef", security.rc4(b"0123456789abcdef", data)) == data
    assert security.aes_open(b"0123456789abcdef", security.aes_seal(b"0123456789abcdef", data, bytes(16))) == data
    assert time.process_time() - began < 5


def _locked(r, v, bits, aes):
    """A file encrypted with an empty user password and the owner password `owner`."""
    doc, file_id = made("Hello, Encrypted PDF!"), b"0123456789abcdef"
    size = bits // 8
    d = {Name("Filter"): Name("Standard"), Name("V"): v, Name("R"): r, Name("Length"): bits, Name("P"): -4}
    h = hashlib.md5((b"owner" + security.PAD)[:32]).digest()
    for _ in range(50 if r >= 3 else 0):
        h = hashlib.md5(h).digest()
    o = security.PAD
    for i in range(20 if r >= 3 else 1):
        o = security.rc4(bytes(c ^ i for c in h[:size]), o)
    d[Name("O")] = Str(o)
    if v == 4:
        d |= {Name("CF"): {Name("StdCF"): {Name("CFM"): Name("AESV2" if aes else "V2")}}, Name("StmF"): Name("StdCF"), Name("StrF"): Name("StdCF")}
    handler = security.Handler.__new__(security.Handler)
    handler.d, handler.id, handler.r, handler.size, handler.meta = d, file_id, r, size, True
    key = handler._key_r4(b"")
    if r == 2:
        u = security.rc4(key, security.PAD)
    else:
        u = security.rc4(key, hashlib.md5(security.PAD + file_id).digest())
        for i in range(1, 20):
            u = security.rc4(bytes(c ^ i for c in key), u)
        u += bytes(16)
    d[Name("U")] = Str(u)
    handler.key = key

    def seal(x, ref):
        if isinstance(x, Stream):
            k = handler.object_key(ref, aes)
            return Stream(x.dict, security.aes_seal(k, x.data, bytes(range(16))) if aes else security.rc4(k, x.data))
        return x

    objects = {ref: seal(o, ref) for ref, o in doc.objects.items()}
    lock = Ref(90, 0)
    raw = files.write_file({**objects, lock: d}, doc.trailer)
    return raw.replace(b"trailer\n<<", b"trailer\n<</Encrypt 90 0 R /XID 1 ").replace(b"/ID [", b"/ID [<" + file_id.hex().encode() + b"> ")


@pytest.mark.parametrize("r, v, bits, aes", [(2, 1, 40, False), (3, 2, 128, False), (4, 4, 128, False), (4, 4, 128, True)])
def test_encrypted_files(r, v, bits, aes):
    raw = _locked(r, v, bits, aes)
    for password in (b"", b"owner"):
        doc = Document.read(raw, password)
        assert page_text(doc, doc.page(0)) == "Hello, Encrypted PDF!"


def test_revision_6():
    key, u_salt, o_salt = bytes(range(32)), b"saltUUUUkeysalt1", b"saltOOOOkeysalt2"
    u = security.hash_r6(b"", u_salt[:8]) + u_salt
    o = security.hash_r6(b"owner", o_salt[:8], u) + o_salt
    d = {"Filter": "Standard", "V": 5, "R": 6, "U": u, "O": o, "CF": {"StdCF": {"CFM": "AESV3"}}, "StmF": "StdCF", "StrF": "StdCF",
         "UE": security.cbc_encrypt(security.hash_r6(b"", u_salt[8:]), key, bytes(16)), "OE": security.cbc_encrypt(security.hash_r6(b"owner", o_salt[8:], u), key, bytes(16))}
    for password in (b"", b"owner"):
        h = security.Handler(d, b"", password)
        assert h.key == key and h.decrypt(security.aes_seal(key, b"text", bytes(16)), Ref(1, 0), "aes256") == b"text"
    with pytest.raises(files.FileFault):
        security.Handler(d, b"", b"wrong")


# --- rendering


def canvas(content, w=60, h=40, **kw):
    doc = Document()
    page = doc.add_page(w, h)
    doc.append_content(page, content)
    return doc, page, render_page(doc, page, **kw)


def test_fills_strokes_and_clips():
    _, _, px = canvas(b"1 0 0 rg 10 10 20 20 re f 0 0 1 RG 4 w 40 5 m 40 35 l S q 50 0 10 40 re W n 0 1 0 rg 0 0 60 10 re f Q")
    assert px[20, 20].tolist() == [255, 0, 0, 255] and px[20, 40].tolist() == [0, 0, 255, 255] and px[35, 55].tolist() == [0, 255, 0, 255] and px[35, 20].tolist() == [255] * 4
    _, _, eo = canvas(b"0 g 0 0 40 40 re 10 10 20 20 re f*")
    assert eo[20, 20, 0] == 255 and eo[5, 5, 0] == 0
    _, _, dash = canvas(b"[6 4] 0 d 4 w 0 20 m 60 20 l S")
    assert dash[20, 3, 0] == 0 and dash[20, 8, 0] == 255


def test_tiles_are_crops():
    doc, page, full = canvas(b"0.2 0.5 0.7 rg 5 5 30 30 re f 3 w 0 0 m 60 40 l S 1 0 0 rg 30 20 m 30 40 60 40 60 20 c f", scale=3.0)
    for y in range(0, 120, 50):
        for x in range(0, 180, 50):
            w, h = min(50, 180 - x), min(50, 120 - y)
            tile = render_page(doc, page, 3.0, (x, y, w, h))
            assert np.abs(tile.astype(int) - full[y : y + h, x : x + w]).max() <= 1
    assert (from_png(png(full)) == full).all()


def test_images_masks_and_blends():
    _, _, px = canvas(b"q 40 0 0 40 0 0 cm BI /W 2 /H 2 /CS /RGB /BPC 8 ID \xff\0\0\0\xff\0\0\0\xff\xff\xff\xff EI Q", fast=True)
    assert [px[y, x, :3].tolist() for y, x in ((5, 5), (5, 35), (35, 5), (35, 35))] == [[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]
    _, _, stencil = canvas(b"1 0 0 rg q 40 0 0 40 0 0 cm BI /W 2 /H 1 /IM true /BPC 1 ID \x40 EI Q", fast=True)
    assert stencil[20, 10, :3].tolist() == [255, 0, 0] and stencil[20, 30, :3].tolist() == [255] * 3
    doc = Document()
    page = doc.add_page(20, 20)
    doc.own_resources(page, "ExtGState")[Name("G")] = {Name("BM"): Name("Multiply"), Name("ca"): 0.5}
    doc.append_content(page, b"1 0 0 rg 0 0 20 20 re f /G gs 0 0 1 rg 0 0 20 20 re f")
    assert np.abs(render_page(doc, page)[10, 10].astype(int) - [128, 0, 0, 255]).max() <= 1


def test_shadings_and_patterns():
    doc = Document()
    page = doc.add_page(60, 40)
    f = {Name("FunctionType"): 2, Name("Domain"): [0, 1], Name("C0"): [1.0, 0.0, 0.0], Name("C1"): [0.0, 0.0, 1.0], Name("N"): 1}
    doc.own_resources(page, "Shading")[Name("A")] = {Name("ShadingType"): 2, Name("ColorSpace"): Name("DeviceRGB"), Name("Coords"): [0, 0, 60, 0], Name("Function"): f}
    doc.append_content(page, b"/A sh")
    px = render_page(doc, page).astype(int)
    assert px[20, 1, 0] > 240 and px[20, 58, 2] > 240 and abs(px[20, 30, 0] - 127) < 8
    radial = {Name("ShadingType"): 3, Name("ColorSpace"): Name("DeviceRGB"), Name("Coords"): [30, 20, 0, 30, 20, 15], Name("Function"): f}
    doc.own_resources(page, "Shading")[Name("A")] = radial
    px = render_page(doc, page).astype(int)
    assert px[20, 30, 0] > 230 and px[20, 2].tolist() == [255] * 4
    cell = doc.add(Stream({Name("PatternType"): 1, Name("PaintType"): 1, Name("BBox"): [0, 0, 10, 10], Name("XStep"): 20, Name("YStep"): 20, Name("Resources"): {}}, b"0 1 0 rg 0 0 5 10 re f"))
    doc.own_resources(page, "Pattern")[Name("P")] = cell
    doc.get(page).pop("Contents")
    doc.append_content(page, b"1 0 0 rg 0 0 60 40 re f /Pattern cs /P scn 0 0 60 40 re f")
    px = render_page(doc, page)
    assert px[35, 2, :3].tolist() == [0, 255, 0] and px[35, 7, :3].tolist() == [255] * 3 and px[35, 15, :3].tolist() == [255, 0, 0]


def test_embedded_truetype_glyphs():
    import struct

    from leafmill.sources.truetype import TrueType, subset

    square = struct.pack(">hhhhh", 1, 0, 0, 1000, 1000) + struct.pack(">HH", 3, 0) + b"\1\1\1\1" + struct.pack(">4h", 0, 1000, 0, -1000) + struct.pack(">4h", 0, 0, 1000, 0)
    glyf = square + b"\0" * (-len(square) % 4)
    tables = {
        b"head": struct.pack(">IIIIHHQQhhhhHHhhh", 0x10000, 0, 0, 0x5F0F3CF5, 0, 1000, 0, 0, 0, 0, 1000, 1000, 0, 8, 2, 0, 0), b"maxp": struct.pack(">IH", 0x10000, 2),
        b"hhea": struct.pack(">I3h", 0x10000, 800, -200, 0) + bytes(24) + struct.pack(">H", 2), b"hmtx": struct.pack(">HhHh", 500, 0, 1000, 0),
        b"loca": struct.pack(">3H", 0, 0, len(glyf) // 2), b"glyf": glyf, b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHHHHHHHH", 65, 65535, 0, 65, 65535, 65536 - 64, 1, 0, 0),
    }
    out, body = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b""
    for tag, b in sorted(tables.items()):
        out += tag + struct.pack(">III", 0, 12 + 16 * len(tables) + len(body), len(b))
        body += b + b"\0" * (-len(b) % 4)
    font = TrueType(out + body)
    assert font.cmap[65] == 1 and font.advance(1) == 1000 and len(font.contours(1)[0]) == 4
    small = TrueType(subset(font, {1}))
    assert small.contours(1) == font.contours(1) and small.count == 2 and TrueType(subset(font, set())).contours(1) == []
    from leafmill.sources.embedding import EmbeddedFont

    own = Document()
    sheet = own.add_page(40, 40)
    face = EmbeddedFont(own, out + body, "Square")
    face.add_text(own, sheet, "AA\nA", 5, 25, 10)
    raw = own.write()
    assert own.write() == raw and face.width("AA\n", 10) == 20
    again = Document.read(raw)
    assert page_text(again, again.page(0)) == "AA\nA" and render_page(again, again.page(0))[10, 10, 0] == 0
    doc = Document()
    page = doc.add_page(40, 40)
    s = doc.add(Stream({}, out + body))
    doc.own_resources(page, "Font")[Name("T")] = {Name("Type"): Name("Font"), Name("Subtype"): Name("TrueType"), Name("FirstChar"): 65, Name("Widths"): [1000], Name("FontDescriptor"): {Name("FontFile2"): s}}
    doc.append_content(page, b"BT /T 20 Tf 10 10 Td (A) Tj ET")
    px = render_page(doc, page)
    assert px[20, 20].tolist() == [0, 0, 0, 255] and px[5, 20, 0] == 255 and page_text(doc, page) == "A"


def test_type2_charstrings():
    from leafmill.operators.raster import Path
    from leafmill.sources.cff import _Machine

    class Font:
        globals = []

    num = lambda v: bytes([28]) + v.to_bytes(2, "big", signed=True)
    path = Path()
    code = num(50) + num(10) + num(20) + b"\x15" + num(100) + b"\x06" + num(100) + b"\x07" + num(-100) + b"\x06" + b"\x0e"
    _Machine(Font, [], path, (1, 0, 0, 1, 0, 0)).glyph(code)
    assert path.subs[0][0][:4] == [(10, 20), (110, 20), (110, 120), (10, 120)]
    assert Op("x", []) == Op("x", [])


def test_encodings_and_names():
    from leafmill.operators.glyphs import glyph_text
    from leafmill.sources.encodings import family, table

    assert table("StandardEncoding")[0x27] == "’" and table("MacRomanEncoding")[0x8A] == "ä" and table("WinAnsiEncoding")[0x80] == "€"
    assert [glyph_text(n) for n in ("A", "eacute", "uni20AC", "u1F600", "germandbls", "nonsense")] == ["A", "é", "€", "😀", "ß", None]
    assert family("ABCDEF+Arial-BoldItalicMT") == ("sans", True, True) and family("Unknown", 2) == ("serif", False, False) and family("CourierNew")[0] == "monospace"
