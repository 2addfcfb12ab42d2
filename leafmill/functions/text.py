"""Column functions on strings, bytes and numbers as PDF files write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths of U+0020 .. U+007E in thousandths of an em (Adobe font metrics).
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
HELVETICA_BOLD = [
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611,
    611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
]
TIMES_ROMAN = [
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278,
    500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722,
    556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500,
    500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
]
#: Code points of WinAnsi bytes 0x80 .. 0x9F; None is undefined.
WINANSI_80 = [
    0x20AC, None, 0x201A, 0x0192, 0x201E, 0x2026, 0x2020, 0x2021, 0x02C6, 0x2030, 0x0160, 0x2039, 0x0152, None, 0x017D, None,
    None, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x02DC, 0x2122, 0x0161, 0x203A, 0x0153, None, 0x017E, 0x0178,
]


def width_table(font: str) -> list[int]:
    """Widths of the printable ASCII characters of a standard font; 500 stands for every other character."""
    name = font.split("+")[-1]
    if name.startswith("Courier"):
        return [600] * 95
    if name.startswith("Helvetica"):
        return HELVETICA_BOLD if "Bold" in name else HELVETICA
    if name.startswith("Times"):
        return TIMES_ROMAN
    return [500] * 95


def text_width(text: Column, font: str, size: float) -> Column:
    """Width of a text in points: one pass over its characters, all in the JVM."""
    widths = width_table(font)
    by_width: dict[int, str] = {}
    for i, w in enumerate(widths):
        by_width.setdefault(w, "")
        by_width[w] += chr(32 + i)
    total = F.char_length(text) * 500
    for w, chars in sorted(by_width.items()):
        if w != 500:  # characters of one width are counted by taking them out
            gone = F.char_length(text) - F.char_length(F.translate(text, chars, ""))
            total = total + gone * (w - 500)
    return total * F.lit(float(size)) / F.lit(1000.0)


def fold(text: Column, ignore_case: bool = False) -> Column:
    """Search form: each white-space character becomes one space, none is merged; lower case if asked for."""
    out = F.regexp_replace(text, "(?U)\\s", " ")
    return F.lower(out) if ignore_case else out


def hit_count(text: Column, query: str, ignore_case: bool = False) -> Column:
    """Non-overlapping literal occurrences, left to right; none for an empty query or one of spaces only."""
    if not query.strip():
        return F.lit(0)
    q = "".join(" " if c.isspace() else c for c in (query.lower() if ignore_case else query))
    t = fold(text, ignore_case)
    return ((F.char_length(t) - F.char_length(F.replace(t, F.lit(q)))) / len(q)).cast("int")


def format_real(v: Column) -> Column:
    """A real number as it is written to a file: whole numbers plainly, others with six places at most."""
    whole = (F.floor(v) == v) & (F.abs(v) < 1e15)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""), "\\.$", "")
    text = F.when(text.isin("-0", ""), "0").otherwise(text)
    return F.when(v.isNull(), None).when(F.isnan(v) | (F.abs(v) == float("inf")), "0").when(whole, F.format_string("%d", v.cast("long"))).otherwise(text)


def adler32(raw: Column) -> Column:
    """Adler-32 of bytes. The second sum is a weighted sum of the first, so both fold over an array at once."""

    def of(raw):
        codes = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
        codes = F.when(F.length(raw) > 0, codes).otherwise(F.array().cast("array<bigint>"))
        start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        return F.aggregate(codes, start, lambda s, x: F.struct(((s.a + x) % 65521).alias("a"), ((s.b + s.a + x) % 65521).alias("b")), lambda s: s.b * 65536 + s.a)

    # as a lambda's variable the bytes are computed once, not for each of them
    return F.element_at(F.transform(F.array(raw), of), 1)


def parse_number(text: Column) -> Column:
    """Value of a number literal (`.5`, `4.`, `-.7`, `+3`); null where the literal is not a number."""
    clean = F.when(text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), text)
    return clean.try_cast("double")


def decode_winansi(raw: Column) -> Column:
    """Text of WinAnsi bytes; the five undefined codes give U+FFFD."""
    source = "".join(chr(0x80 + i) for i in range(32))
    target = "".join(chr(c) if c else "�" for c in WINANSI_80)
    return F.translate(F.decode(raw, "ISO-8859-1"), source, target)


def encode_winansi_text(text: Column) -> Column:
    """Text with every character that WinAnsi lacks replaced by `?`."""
    extra = "".join(chr(c) for c in WINANSI_80 if c)
    return F.regexp_replace(text, f"[^\\x{{00}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}{extra}]", "?")


def decode_text_string(raw: Column) -> Column:
    """A text string by its byte-order mark: UTF-16BE, UTF-8, else WinAnsi."""
    head = F.hex(raw)
    return F.when(head.startswith("FEFF"), F.decode(F.substring(raw, F.lit(3), F.length(raw)), "UTF-16BE")).when(head.startswith("EFBBBF"), F.decode(F.substring(raw, F.lit(4), F.length(raw)), "UTF-8")).otherwise(decode_winansi(raw))


def encode_text_string(text: Column) -> Column:
    """ASCII as it is, anything else as UTF-16BE behind its mark."""
    return F.when(text.rlike("^[\\x00-\\x7F]*$"), F.encode(text, "US-ASCII")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))


def hex_string(text: Column) -> Column:
    """Bytes of a hex string: white space is skipped, a missing last digit is 0."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.char_length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def split_codes(raw: Column, width: int = 2) -> Column:
    """Character codes of a string: big-endian pairs, an odd last byte is a code of its own."""
    n = F.ceil(F.length(raw) / F.lit(width)).cast("int")
    codes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(raw, i * width + 1, F.lit(width))), 16, 10).cast("int"))
    return F.when(F.length(raw) > 0, codes).otherwise(F.array().cast("array<int>"))


def roman(n: Column) -> Column:
    """Upper-case roman numeral; thousands repeat M."""
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    digit = lambda k: F.floor(n / 10**k) % 10
    pick = lambda k, a, b, c: F.element_at(F.array(*[F.lit(o.replace("X", "\0").replace("V", b).replace("I", a).replace("\0", c)) for o in ones]), (digit(k) + 1).cast("int"))
    thousands = F.least(F.floor(n / 1000), F.lit(257)).cast("int")
    full = F.concat(F.repeat(F.lit("M"), thousands), pick(2, "C", "D", "M"), pick(1, "X", "L", "C"), pick(0, "I", "V", "X"))
    return F.when(n < 1, "").when(thousands > 256, F.repeat(F.lit("M"), F.lit(257))).otherwise(full)


def letters(n: Column) -> Column:
    """A .. Z, then AA .. ZZ, AAA ..: one letter repeated, 64 times at most."""
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ((n - 1) % 26 + 1).cast("int"), F.lit(1))
    return F.when(n < 1, "").otherwise(F.repeat(letter, F.least(F.floor((n - 1) / 26) + 1, F.lit(64)).cast("int")))


def page_label(index: Column, start: Column, style: Column, prefix: Column, first: Column) -> Column:
    """Label of a page: prefix and numeral of first + (index - start); without a range the page number."""
    n = F.when(first >= 1, first).otherwise(1) + index - start
    number = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", letters(n)).when(style == "a", F.lower(letters(n))).otherwise("")
    return F.when(start.isNull(), (index + 1).cast("string")).otherwise(F.concat(F.coalesce(prefix, F.lit("")), number))


def escape_name(text: Column) -> Column:
    """A name as written to a file: bytes outside `!`..`~` and the delimiters become #xx."""
    chars = F.transform(F.sequence(F.lit(1), F.length(F.encode(text, "UTF-8"))), lambda i: F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))))
    plain = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "#()<>[]{}/%")
    codes = F.array(*[F.lit(f"{ord(c):02X}") for c in plain])
    shown = F.transform(chars, lambda h: F.when(F.array_contains(codes, h), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("#"), h)))
    return F.concat(F.lit("/"), F.when(F.char_length(text) > 0, F.array_join(shown, "")).otherwise(""))


def header_version(raw: Column) -> Column:
    """Version behind %PDF- in the first 1,024 bytes; null where there is none."""
    v = F.regexp_extract(F.decode(F.substring(raw, 1, 1024), "ISO-8859-1"), "%PDF-([0-9.]+)", 1)
    return F.when(v != "", v)
