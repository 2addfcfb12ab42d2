"""Queries of the column functions. They borrow columns of the supplied tables as inputs: what they show is arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import color as C
from leafmill.functions import geometry as G
from leafmill.functions import pdf_functions as P
from leafmill.functions import text as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, table: str, columns, sql: str | None, keys: tuple = ()):
    """Register a projection of one table; columns(df) gives its output columns."""

    def run(spark, sf_dir):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(*keys, *columns(df))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE[name] = f"select {', '.join([*keys, sql])} from {table}"


LINE = ("l_orderkey", "l_linenumber")

# --- strings and bytes
add("search_hits_ci", "documents", lambda d: [T.hit_count(d.text, "The", True).alias("hits")], "cast((length(lower(regexp_replace(text, '\\s', ' ', 'g'))) - length(replace(lower(regexp_replace(text, '\\s', ' ', 'g')), 'the', ''))) / 3 as int) as hits", ("doc_id",))
add("text_hashes", "documents", lambda d: [F.md5(d.text).alias("md5"), F.sha2(d.text, 256).alias("sha256")], "md5(text) as md5, sha256(text) as sha256", ("doc_id",))
add("text_hashes_long", "documents", lambda d: [F.sha2(d.text, 384).alias("sha384"), F.sha2(d.text, 512).alias("sha512"), F.crc32(F.encode("text", "UTF-8")).alias("crc32")], None, ("doc_id",))
add("hex_roundtrip", "documents", lambda d: [F.hex(F.encode(d.text, "UTF-8")).alias("hex"), F.decode(T.hex_string(F.hex(F.encode(d.text, "UTF-8"))), "UTF-8").alias("back")], "hex(text) as hex, text as back", ("doc_id",))
add("hex_string_odd", "orders", lambda d: [F.hex(T.hex_string(F.concat(F.lit("4 1\n"), F.hex(d.o_orderkey)))).alias("raw")], "case when length('41' || hex(o_orderkey)) % 2 = 1 then '41' || hex(o_orderkey) || '0' else '41' || hex(o_orderkey) end as raw", ("o_orderkey",))
_HEAD = "substring(text, 1, 400)"
_CODES = f"list_transform(range(octet_length(encode({_HEAD}))), lambda i: ('0x' || substring(hex({_HEAD}), 2 * i + 1, 2))::bigint)"
_WEIGHTED = f"list_transform(range(octet_length(encode({_HEAD}))), lambda i: (octet_length(encode({_HEAD})) - i) * ('0x' || substring(hex({_HEAD}), 2 * i + 1, 2))::bigint)"
add("adler32_text", "documents", lambda d: [T.adler32(F.encode(F.substring("text", 1, 400), "UTF-8")).alias("adler32")],
    f"cast((1 + coalesce(list_sum({_CODES}), 0)) % 65521 + 65536 * ((octet_length(encode({_HEAD})) + coalesce(list_sum({_WEIGHTED}), 0)) % 65521) as bigint) as adler32", ("doc_id",))
#: Whole texts; the same form in DuckDB is too slow for them, tests hold it against zlib.
add("adler32_whole_text", "documents", lambda d: [T.adler32(F.encode("text", "UTF-8")).alias("adler32")], None, ("doc_id",))
add("format_real", "lineitem", lambda d: [T.format_real(d.l_extendedprice * d.l_discount).alias("text")], "case when l_extendedprice * l_discount = floor(l_extendedprice * l_discount) then cast(cast(l_extendedprice * l_discount as bigint) as varchar) else regexp_replace(regexp_replace(printf('%.6f', l_extendedprice * l_discount), '0+$', ''), '\\.$', '') end as text", LINE)
for font, name in (("Helvetica", "helvetica"), ("Helvetica-Bold", "helvetica_bold"), ("Times-Roman", "times"), ("Courier", "courier")):
    groups: dict[int, str] = {}
    for i, w in enumerate(T.width_table(font)):
        groups[w] = groups.get(w, "") + chr(32 + i).replace("'", "''")
    total = " + ".join(["500 * length(text)", *(f"({w - 500}) * (length(text) - length(translate(text, '{chars}', '')))" for w, chars in groups.items() if w != 500)])
    add(f"text_width_{name}", "documents", lambda d, font=font: [F.round(T.text_width(d.text, font, 12.0), 6).alias("width")], f"round(({total}) * 12.0 / 1000.0, 6)::double as width", ("doc_id",))
add("winansi_fallback", "documents", lambda d: [T.encode_winansi_text(d.text).alias("shown")], "regexp_replace(text, '[^\\x{00}-\\x{7F}\\x{A0}-\\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g') as shown", ("doc_id",))
add("text_string_roundtrip", "documents", lambda d: [T.decode_text_string(T.encode_text_string(d.text)).alias("text2")], "text as text2", ("doc_id",))
add("code_split", "documents", lambda d: [F.size(T.split_codes(F.encode("lang", "UTF-8"))).alias("n"), T.split_codes(F.encode("source", "UTF-8")).alias("codes")], "cast(ceil(octet_length(encode(lang)) / 2.0) as int) as n, list_transform(range(cast(ceil(octet_length(encode(source)) / 2.0) as bigint)), lambda i: if(2 * i + 2 <= octet_length(encode(source)), ord(source[2 * i + 1]) * 256 + ord(source[2 * i + 2]), ord(source[2 * i + 1]))::int) as codes", ("doc_id",))
add("number_literals", "orders", lambda d: [T.parse_number(F.concat(F.lit("-."), d.o_orderkey.cast("string"))).alias("a"), T.parse_number(F.concat(d.o_orderkey.cast("string"), F.lit("."))).alias("b"), T.parse_number(F.concat(F.lit("1.2."), d.o_orderkey.cast("string"))).alias("c")], "cast('-0.' || o_orderkey as double) as a, cast(o_orderkey as double) as b, cast(null as double) as c", ("o_orderkey",))
add("name_escapes", "nation", lambda d: [T.escape_name(F.concat("n_name", F.lit(" (#1)"))).alias("name")], "'/' || replace(n_name, ' ', '#20') || '#20#28#231#29' as name", ("n_nationkey",))
add("page_label_format", "orders", lambda d: [T.page_label(d.o_orderkey % 4500, F.lit(0), F.element_at(F.array(*[F.lit(s) for s in "DRrAa"]), (d.o_orderkey % 5 + 1).cast("int")), F.lit("p-"), F.lit(1)).alias("label")],
    "'p-' || case o_orderkey % 5 when 0 then cast(o_orderkey % 4500 + 1 as varchar) when 1 then ROMAN when 2 then lower(ROMAN) when 3 then repeat(chr(cast(65 + o_orderkey % 4500 % 26 as int)), least(64, o_orderkey % 4500 // 26 + 1)) else repeat(chr(cast(97 + o_orderkey % 4500 % 26 as int)), least(64, o_orderkey % 4500 // 26 + 1)) end as label".replace("ROMAN", "(repeat('M', (o_orderkey % 4500 + 1) // 1000) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(o_orderkey % 4500 + 1) // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(o_orderkey % 4500 + 1) // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][(o_orderkey % 4500 + 1) % 10 + 1])"), ("o_orderkey",))

# --- colours
_CH = "cast(floor(least(greatest(%s, 0), 1) * 255 + 0.5) as int)"


def three(made, names=("r", "g", "b")):
    return [made.getField(n).alias(n) for n in names]


add("gray_to_rgb", "lineitem", lambda d: three(C.gray_to_rgb(d.l_discount * 10)), ", ".join(f"{_CH % 'l_discount * 10'} as {c}" for c in "rgb"), LINE)
add("cmyk_to_rgb", "lineitem", lambda d: three(C.cmyk_to_rgb(d.l_discount * 10, d.l_tax * 10, d.l_quantity / 50, d.l_discount)), ", ".join(f"{_CH % f'1 - least(1, {v} + l_discount)'} as {c}" for c, v in zip("rgb", ("l_discount * 10", "l_tax * 10", "l_quantity / 50"))), LINE)
_CUBE = "case when {t} > 6.0::double / 29 then {t} * {t} * {t} else 3.0::double * (6.0::double / 29) * (6.0::double / 29) * ({t} - 4.0::double / 29) end"
_FY = "((l_quantity * 2 + 16.0::double) / 116)"
_LX, _LY, _LZ = (f"(({_CUBE.format(t=t)}) * {w}::double)" for t, w in ((f"((l_discount * 1000 - 50) / 500 + {_FY})", 0.9505), (_FY, 1.0), (f"({_FY} - (l_tax * 1000 - 40) / 200)", 1.089)))
_GAMMA = "case when {v} <= 0.0031308 then 12.92 * {v} else 1.055 * pow({v}, 1 / 2.4::double) - 0.055 end"


def _lab(p, q, r):
    v = f"least(greatest({p}::double * {_LX} + {q}::double * {_LY} + {r}::double * {_LZ}, 0), 1)"
    return _CH % f"({_GAMMA.format(v=v)})"


add("lab_to_rgb", "lineitem", lambda d: three(C.lab_to_rgb(d.l_quantity * 2, d.l_discount * 1000 - 50, d.l_tax * 1000 - 40)), f"{_lab(3.2404542, -1.5371385, -0.4985314)} as r, {_lab(-0.9692660, 1.8760108, 0.0415560)} as g, {_lab(0.0556434, -0.2040259, 1.0572252)} as b", LINE)
_TABLE = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 8, 7)]
add("indexed_rgb", "lineitem", lambda d: three(C.indexed(d.l_quantity / 8 - 1, _TABLE)), ", ".join(f"{[t[i] for t in _TABLE]}[cast(least(greatest(floor(l_quantity / 8 - 1 + 0.5), 0), 4) as int) + 1] as {c}" for i, c in enumerate("rgb")), LINE)
_FIT = "cast(least(greatest(floor(%s + 0.5), 0), 255) as int)"
add("ycbcr_to_rgb", "lineitem", lambda d: three(C.ycbcr_to_rgb(d.l_quantity * 5, d.l_discount * 2550, d.l_tax * 3187)), f"{_FIT % 'l_quantity * 5 + 1.402::double * (l_tax * 3187 - 128)'} as r, {_FIT % 'l_quantity * 5 - 0.344136::double * (l_discount * 2550 - 128) - 0.714136::double * (l_tax * 3187 - 128)'} as g, {_FIT % 'l_quantity * 5 + 1.772::double * (l_discount * 2550 - 128)'} as b", LINE)
add("decode_map", "lineitem", lambda d: [F.round(C.decode_map(d.l_quantity, 1.0, -1.0, 255), 9).alias("v")], "round(1.0::double + l_quantity * -2.0::double / 255, 9) as v", LINE)


def _b(d):
    return [d.l_orderkey % 256, d.l_partkey % 256, (d.l_quantity * 5).cast("long") % 256]


def _s(d):
    return [d.l_suppkey * 37 % 256, d.l_extendedprice.cast("long") % 256, d.l_partkey * 7 % 256]


_BQ = ["l_orderkey % 256", "l_partkey % 256", "cast(trunc(l_quantity * 5) as bigint) % 256"]
_SQ = ["l_suppkey * 37 % 256", "cast(trunc(l_extendedprice) as bigint) % 256", "l_partkey * 7 % 256"]
_f = lambda v: f"cast({v} as float)"
_U8 = "cast(floor(least(greatest({v}, cast(0 as float)), cast(1 as float)) * cast(255 as float) + cast(0.5 as float)) as int)"
_HARD = "case when {s} <= cast(0.5 as float) then {b} * (cast(2 as float) * {s}) else {b} + (cast(2 as float) * {s} - cast(1 as float)) - {b} * (cast(2 as float) * {s} - cast(1 as float)) end"
_MODES = {
    "Normal": "{s}", "Multiply": "{b} * {s}", "Screen": "{b} + {s} - {b} * {s}", "Overlay": _HARD.replace("{b}", "\0").replace("{s}", "{b}").replace("\0", "{s}"),
    "Darken": "least({b}, {s})", "Lighten": "greatest({b}, {s})", "Difference": "abs({b} - {s})", "Exclusion": "{b} + {s} - cast(2 as float) * {b} * {s}", "HardLight": _HARD,
    "ColorDodge": "case when {s} >= 1 then cast(1 as float) else least(cast({b} / (cast(1 as float) - {s}) as float), cast(1 as float)) end",
    "ColorBurn": "case when {s} <= 0 then cast(0 as float) else cast(1 as float) - least(cast((cast(1 as float) - {b}) / {s} as float), cast(1 as float)) end",
    "SoftLight": "case when {s} <= cast(0.5 as float) then {b} - (cast(1 as float) - cast(2 as float) * {s}) * {b} * (cast(1 as float) - {b}) else {b} + (cast(2 as float) * {s} - cast(1 as float)) * ((case when {b} <= cast(0.25 as float) then ((cast(16 as float) * {b} - cast(12 as float)) * {b} + cast(4 as float)) * {b} else cast(sqrt({b}) as float) end) - {b}) end",
}
for mode in [*C.SEPARABLE, *C.NONSEPARABLE]:
    add(f"blend_{mode.lower()}", "lineitem", lambda d, mode=mode: three(C.blend(_b(d), _s(d), mode)), None, LINE)
    if mode in _MODES:
        ORACLE[f"blend_{mode.lower()}"] = "with u as (select l_orderkey, l_linenumber, " + ", ".join(f"cast(cast({q} as float) / cast(255 as float) as float) as {n}{i}" for n, qs in (("b", _BQ), ("s", _SQ)) for i, q in enumerate(qs)) + ") select l_orderkey, l_linenumber, ".replace(") select", " from lineitem) select") + ", ".join(f"{_U8.format(v='(' + _MODES[mode].format(b=f'b{i}', s=f's{i}') + ')')} as {c}" for i, c in enumerate("rgb")) + " from u"
_LUM = "(cast(0.3 as float) * {0}0 + cast(0.59 as float) * {0}1 + cast(0.11 as float) * {0}2)"
_MIN, _MAX = "least({0}0, {0}1, {0}2)", "greatest({0}0, {0}1, {0}2)"


def _nonseparable(mode: str) -> str:
    """Steps as nested selects: c is the colour to shift, t the luminosity it gets, then two clips."""
    a, light = {"Hue": ("s", "b"), "Saturation": ("b", "b"), "Color": ("s", "b"), "Luminosity": ("b", "s")}[mode]
    other = {"Hue": "b", "Saturation": "s"}.get(mode)
    unit = "select l_orderkey, l_linenumber, " + ", ".join(f"cast(cast({q} as float) / cast(255 as float) as float) as {n}{i}" for n, qs in (("b", _BQ), ("s", _SQ)) for i, q in enumerate(qs)) + " from lineitem"
    lo, hi = _MIN.format(a), _MAX.format(a)
    if other:
        sat = f"({_MAX.format(other)} - {_MIN.format(other)})"
        c = [f"case when {hi} > {lo} then case when {a}{i} = {hi} then {sat} when {a}{i} = {lo} then cast(0 as float) else cast(({a}{i} - {lo}) * {sat} / ({hi} - {lo}) as float) end else cast(0 as float) end" for i in range(3)]
    else:
        c = [f"{a}{i}" for i in range(3)]
    s1 = f"select *, {', '.join(f'{x} as c{i}' for i, x in enumerate(c))}, {_LUM.format(light)} as t from ({unit})"
    s2 = f"select l_orderkey, l_linenumber, {', '.join(f'c{i} + (t - {_LUM.format('c')}) as d{i}' for i in range(3))} from ({s1})"
    s3 = f"select *, {_LUM.format('d')} as l, {_MIN.format('d')} as n, {_MAX.format('d')} as x from ({s2})"
    s4 = f"select l_orderkey, l_linenumber, l, x, {', '.join(f'case when n >= 0 then d{i} when abs(l - n) > cast(1e-9 as float) then cast(l + (d{i} - l) * l / (l - n) as float) else l end as e{i}' for i in range(3))} from ({s3})"
    s5 = f"select l_orderkey, l_linenumber, {', '.join(f'case when x <= 1 then e{i} when abs(x - l) > cast(1e-9 as float) then cast(l + (e{i} - l) * (cast(1 as float) - l) / (x - l) as float) else l end as g{i}' for i in range(3))} from ({s4})"
    return f"select l_orderkey, l_linenumber, {', '.join(f'{_U8.format(v=f'g{i}')} as {c}' for i, c in enumerate('rgb'))} from ({s5})"


for mode in C.NONSEPARABLE:
    ORACLE[f"blend_{mode.lower()}"] = _nonseparable(mode)
add("source_over", "lineitem", lambda d: [C.over(_s(d)[0], _b(d)[0], (d.l_quantity * 5).cast("long")).alias("v")], f"cast(floor((({_SQ[0]}) * cast(trunc(l_quantity * 5) as bigint) + ({_BQ[0]}) * (255 - cast(trunc(l_quantity * 5) as bigint)) + 127) / 255.0::double) as int) as v", LINE)

# --- function objects
add("func_type0", "lineitem", lambda d: [F.round(v, 9).alias(n) for v, n in zip(P.wrap(P.sampled([0, 255, 64, 128, 255, 0], [3], 2, decode=[(0, 1), (0, 2)], top=255.0), [(0, 1)], None)([d.l_discount * 10]), ("a", "b"))],
    "round(case when l_discount * 20 >= 2 then 255.0::double / 255 else (list_extract([0, 64, 255], cast(floor(least(l_discount * 20, 2)) as int) + 1) + (list_extract([0, 64, 255], cast(least(floor(least(l_discount * 20, 2)) + 1, 2) as int) + 1) - list_extract([0, 64, 255], cast(floor(least(l_discount * 20, 2)) as int) + 1)) * (least(l_discount * 20, 2) - floor(least(l_discount * 20, 2)))) / 255.0::double end, 9) as a, round((list_extract([255, 128, 0], cast(floor(least(l_discount * 20, 2)) as int) + 1) + (list_extract([255, 128, 0], cast(least(floor(least(l_discount * 20, 2)) + 1, 2) as int) + 1) - list_extract([255, 128, 0], cast(floor(least(l_discount * 20, 2)) as int) + 1)) * (least(l_discount * 20, 2) - floor(least(l_discount * 20, 2)))) * 2 / 255.0::double, 9) as b", LINE)
add("func_type2", "lineitem", lambda d: [F.round(P.wrap(P.exponential([0.1], [0.9], 1.5), [(0, 1)], [(0, 1)])([d.l_discount * 12])[0], 9).alias("y")], "round(least(greatest(0.1 + pow(least(greatest(l_discount * 12, 0), 1), 1.5::double) * (0.9::double - 0.1::double), 0), 1), 9) as y", LINE)
_ST = P.stitched([P.exponential([0.0], [1.0], 1.0), P.exponential([1.0], [0.0], 2.0)], [0.5], [(0, 1), (0, 1)])
add("func_type3", "lineitem", lambda d: [F.round(P.wrap(_ST, [(0, 1)], None)([d.l_discount * 10])[0], 9).alias("y")], "round(case when least(l_discount * 10, 1) < 0.5 then least(l_discount * 10, 1) / 0.5::double else 1 - pow((least(l_discount * 10, 1) - 0.5::double) / 0.5::double, 2) end, 9) as y", LINE)
_PS = {
    "arith": ("{ dup mul exch 2 exp add sqrt 3 div }", "sqrt(l_tax * l_tax + l_discount * l_discount) / 3", 9),
    "atan": ("{ atan }", "case when degrees(atan2(l_discount - 0.05, l_tax - 0.04)) < 0 then degrees(atan2(l_discount - 0.05, l_tax - 0.04)) + 360 else degrees(atan2(l_discount - 0.05, l_tax - 0.04)) end", 8),
    "branch": ("{ 2 copy gt { sub } { exch sub } ifelse }", "abs(l_discount - l_tax)", 9),
    "stack": ("{ 2 1 roll dup 0 lt { neg } if 1 index add exch pop }", "l_discount + l_tax", 9),
    "round": ("{ pop 100 mul 3.4 add round 7 idiv 3 mod }", "(trunc(floor(l_discount * 100 + 3.4::double + 0.5) / 7) % 3)::double", 9),
    "logic": ("{ 0.04 ge exch 0.05 ge and 1 eq { 10 } { 20 } ifelse }", "case when l_tax >= 0.04 and l_discount >= 0.05 then 10.0 else 20.0 end::double", 9),
    "trig": ("{ 360 mul sin exch 360 mul cos mul }", "sin(radians(l_tax * 360)) * cos(radians(l_discount * 360))", 8),
    "logs": ("{ ln exch log add }", "(case when l_tax = 0 then 0 else ln(l_tax) end + case when l_discount = 0 then 0 else log10(l_discount) end)", 9),
    "bits": ("{ 100 mul cvi exch 100 mul cvi xor 2 bitshift }", "(xor(cast(trunc(l_tax * 100) as bigint), cast(trunc(l_discount * 100) as bigint)) << 2)::double", 9),
}
for key, (program, sql, places) in _PS.items():
    shift = (0.05, 0.04) if key == "atan" else (0.0, 0.0)
    add(f"func_type4_{key}", "lineitem", lambda d, program=program, shift=shift, places=places: [F.round(v, places).alias(f"y{i}") for i, v in enumerate(P.calculator(program)([d.l_discount - shift[0], d.l_tax - shift[1]]))], f"round({sql}, {places}) as y0" if sql else None, LINE)
_WHOLE = "{ 2 copy 100 mul 1.9 add exch 100 mul 0.5 add exch idiv 3 1 roll 100 mul 1.9 add exch 100 mul 0.5 add exch mod }"
_AB = "cast(trunc(l_discount * 100 + 0.5::double) as bigint) {} cast(trunc(l_tax * 100 + 1.9::double) as bigint)"
add("func_type4_whole_division", "lineitem", lambda d: [v.alias(n) for v, n in zip(P.calculator(_WHOLE)([d.l_discount, d.l_tax]), ("q", "r"))], f"({_AB.format('//')})::double as q, ({_AB.format('%')})::double as r", LINE)
# how deep `index` reaches comes from the data: the program can't be compiled to expressions
_DEEP = "{ 100 mul round 3 mod 7 exch 9 exch index 4 1 roll pop pop pop }"
add("func_type4_dynamic", "lineitem", lambda d: [P.program(_DEEP, 1)([d.l_discount, d.l_tax])[0].alias("y")], "case cast(round(l_tax * 100) as int) % 3 when 0 then 9.0::double when 1 then 7.0::double else l_discount end as y", LINE)
add("clamp_interpolate", "lineitem", lambda d: [P.clamp(d.l_quantity, 40, 10).alias("a"), F.round(P.interpolate(d.l_quantity, 1, 50, -1, 1), 9).alias("b")], "least(greatest(l_quantity, 10.0), 40.0)::double as a, round(-1 + (l_quantity - 1) * 2.0::double / 49, 9) as b", LINE)

# --- geometry
add("rect_normalise", "lineitem", lambda d: three(G.rect(d.l_quantity, d.l_discount, d.l_tax, d.l_quantity * 2 - 50), ("x0", "y0", "x1", "y1")), "least(l_quantity, l_tax) as x0, least(l_discount, l_quantity * 2 - 50) as y0, greatest(l_quantity, l_tax) as x1, greatest(l_discount, l_quantity * 2 - 50) as y1", LINE)


def _m(d):
    return G.matrix(F.lit(2.0), d.l_discount, -d.l_tax, F.lit(0.5), d.l_quantity, F.lit(7.0))


add("matrix_aabb", "lineitem", lambda d: [F.round(c, 9).alias(n) for c, n in zip([G.box_of(_m(d), F.lit(0.0), F.lit(0.0), d.l_quantity, F.lit(10.0)).getField(k) for k in ("x0", "y0", "x1", "y1")], ("x0", "y0", "x1", "y1"))],
    "round(least(l_quantity, -l_tax * 10 + l_quantity, 2 * l_quantity + l_quantity, 2 * l_quantity - l_tax * 10 + l_quantity), 9) as x0, round(least(7, 12, l_discount * l_quantity + 7, l_discount * l_quantity + 12), 9) as y0, round(greatest(l_quantity, -l_tax * 10 + l_quantity, 2 * l_quantity + l_quantity, 2 * l_quantity - l_tax * 10 + l_quantity), 9) as x1, round(greatest(7, 12, l_discount * l_quantity + 7, l_discount * l_quantity + 12), 9) as y1", LINE)
add("matrix_inverse", "lineitem", lambda d: [F.round(G.then(_m(d), G.inverse(_m(d))).getField(k), 6).alias(k) for k in "ad"] + [F.round(G.scale_of(_m(d)), 9).alias("scale")], "1.0::double as a, 1.0::double as d, round(sqrt(abs(2 * 0.5 + l_discount * l_tax)), 9) as scale", LINE)
add("page_geometry", "lineitem", lambda d: [G.rotation((d.l_quantity * 30 - 400).cast("int")).alias("rotate"), G.page_size(F.array(F.lit(0.0), F.lit(0.0), d.l_quantity, -d.l_quantity * 2), (d.l_quantity * 30 - 400).cast("int")).getField("width").alias("width")],
    "cast(floor(((cast(trunc(l_quantity * 30 - 400) as int) % 360 + 360) % 360) / 90.0) * 90 as int) as rotate, case when cast(floor(((cast(trunc(l_quantity * 30 - 400) as int) % 360 + 360) % 360) / 90.0) * 90 as int) in (90, 270) then greatest(l_quantity * 2, 1.0) else greatest(l_quantity, 1.0) end as width", LINE)
add("glyph_advance", "lineitem", lambda d: [F.round(G.advance(d.l_quantity * 20, F.lit(12.0), d.l_discount, d.l_tax, F.col("l_linenumber") + 30, F.lit(90.0)), 9).alias("adv")], "round((l_quantity * 20 / 1000 * 12 + l_discount + case when l_linenumber + 30 = 32 then l_tax else 0 end) * 90 / 100, 9) as adv", LINE)
