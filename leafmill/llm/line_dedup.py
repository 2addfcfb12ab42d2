"""Line dedup (operator 4) by content-defined chunks of lines, in DataFrame and SQL functions only.

A text is cut at line ends. A chunk is a run of lines that has `long_words` words, or two lines and
`min_words` words. At each line that isn't blank the shortest chunk that begins there and the shortest that
ends there are taken, and both once more with one and with all of the blank lines next to them. So bounds depend on nothing but
the chunk's own lines, and every run that is large enough is covered by the chunks inside it: a line of the
run from which the run goes on for a chunk begins one, and all lines behind lie in the one that ends it.

A chunk that repeats anywhere is removed from every place but its first (by id, then line), after its bytes
were compared with those of the first. So every repeated run of that size goes, wherever its ends lie.
Every removed line has an equal line at an earlier place, and the earliest of them is always kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stash

LONG_WORDS, MIN_WORDS = 20, 12
#: Repeated chunks that are broadcast at most (hash and first place, some 100 bytes each); more are joined by a shuffle.
BROADCAST_HASHES = 500_000
#: Characters of scripts that are written without blanks; two of them count as a word.
_DENSE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3001-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"
_BLANK = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word of lines in ASCII and of others; what goes on for more than 20 characters without a blank counts as several.
_ASCII_WORD, _WORD = r"\S{1,20}+", rf"(?:[{_DENSE}]{{1,2}}+|[^{_BLANK}{_DENSE}]{{1,20}}+)"


def _inline(df: DataFrame, keep: list[str], **made: str) -> DataFrame:
    """Add columns behind a generator, so that lambdas read finished arrays and don't compute them again."""
    fields = ", ".join(f"'{k}', {v}" for k, v in made.items())
    return df.selectExpr(*keep, f"inline(array(named_struct({fields})))")


def _words(most: int) -> str:
    """Words of line x, `most` at most: what lies behind these isn't read."""
    count = lambda word, blank: f"if(x rlike r'^(?:{blank}*+{word}){{{most}}}', {most}, regexp_count(x, r'{word}'))"
    return f"if(octet_length(x) = char_length(x), {count(_ASCII_WORD, chr(92) + 's')}, {count(_WORD, f'[{_BLANK}]')})"


def chunks(rows: DataFrame, long_words: int, min_words: int, text: bool = False) -> DataFrame:
    """key, ord, s, e, h: half-open line ranges of all chunks with a hash of their lines, and their text as `chunk` if asked for."""
    x = _inline(rows.where("length(text) > 0"), ["key", "ord"], lines="split(text, '\n', -1)")
    x = _inline(x, ["key", "ord", "lines"], hashes="transform(lines, x -> xxhash64(x))", words=f"transform(lines, x -> {_words(long_words)})")
    x = _inline(x, ["key", "ord", "lines", "hashes", "words"], full="filter(sequence(0, size(lines) - 1), i -> words[i] > 0)").where("size(full) > 0")
    most = max(2, min_words)  # lines with words that a chunk can need
    ahead, behind = f"slice(full, j + 1, {most})", f"reverse(slice(full, greatest(j + 2 - {most}, 1), least({most}, j + 1)))"
    # a fold takes lines until they make a chunk: words in the low 32 bits, lines above
    enough = f"(a & 4294967295) >= {long_words} or (a & 4294967295) >= {min_words} and a >= %d * 4294967296L"
    fold = lambda at, lines: f"aggregate({at}, 0L, (a, i) -> if({enough % lines}, a, a + 4294967296L + words[i]))"
    before, after = "coalesce(get(full, j - 1), -1) + 1", "coalesce(get(full, j + 1), size(lines))"
    last, first = "full[j + int(shiftright(a, 32)) - 1] + 1", "full[j - int(shiftright(a, 32)) + 1]"
    ends = [  # blank lines are lines too: with them one line with words is enough
        (f"{fold(ahead, 2)}", 2, "full[j]", last),
        (f"{fold(behind, 2)}", 2, first, "full[j] + 1"),
        (f"if({before} < full[j], {fold(ahead, 1)}, 0L)", 1, before, last),
        (f"if({after} > full[j] + 1, {fold(behind, 1)}, 0L)", 1, first, after),
    ]
    ends += [(a, n, "full[j] - 1" if s is before else s, "full[j] + 2" if e is after else e) for a, n, s, e in ends[2:]]
    ranges = ", ".join(f"transform(transform(sequence(0, size(full) - 1), j -> {a}), (a, j) -> if({enough % n}, named_struct('s', {s}, 'e', {e}), null))" for a, n, s, e in ends)
    x = _inline(x, ["key", "ord", "lines", "hashes"], ranges=f"filter(array_distinct(flatten(array({ranges}))), c -> c is not null)")
    # made before the explode, which would copy the whole text to every chunk
    made = "transform(ranges, c -> named_struct('s', c.s, 'e', c.e, 'h', xxhash64(slice(hashes, c.s + 1, c.e - c.s))%s))" % (", 'chunk', array_join(slice(lines, c.s + 1, c.e - c.s), '\n')" if text else "")
    return x.selectExpr("key", "ord", f"inline({made})")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text replaced by its kept lines, and n_lines, n_removed (lines) added.

    Null and empty texts have no chunks and stay as they are (n_lines 0 for null, 1 for empty). Rows that
    agree in id and text are one document and get the same text. Null ids come first in the order of
    documents. Lines keep their order; chunks of blank lines alone are never removed. Other columns pass
    through; columns named like the two added ones are replaced. An empty table gives no rows.
    Chunks travel as hashes; their bytes are moved only for those that repeat, for the comparison.
    """
    rows = docs.drop("n_lines", "n_removed", "__key").withColumn("__key", F.xxhash64(F.col(id_col).cast("string"), F.lit("/"), F.col(text_col)))
    base = rows.select(F.col("__key").alias("key"), F.col(id_col).alias("ord"), F.col(text_col).alias("text"))
    found = chunks(base, long_words, min_words)
    place = F.struct("ord", "key", "s")
    repeated = found.select("h", place.alias("at")).groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("h", "first")
    repeated = stash(repeated, "line-repeats")
    is_first = "ord <=> first.ord and key = first.key and s = first.s as is_first"
    if repeated.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:  # no text is shuffled
        hit = chunks(base, long_words, min_words, text=True).join(F.broadcast(repeated), "h").selectExpr("h", "key", "s", "e", "chunk", is_first)
    else:  # chunks meet their hash without a text; each text travels once, to its own repeated chunks
        met = chunks(base, long_words, min_words).join(repeated, "h").selectExpr("key", f"struct(h, s, e, {is_first}) as c")
        met = met.groupBy("key").agg(F.collect_set("c").alias("met"))
        hit = _inline(base.dropDuplicates(["key"]).join(met, "key"), ["key", "met"], lines="split(text, '\n', -1)")
        hit = hit.selectExpr("key", "inline(transform(met, c -> named_struct('h', c.h, 's', c.s, 'e', c.e, 'chunk', array_join(slice(lines, c.s + 1, c.e - c.s), '\n'), 'is_first', c.is_first)))").select("h", "key", "s", "e", "chunk", "is_first")
    hit = stash(hit, "line-chunks")
    first = hit.where("is_first").groupBy("h").agg(F.first("chunk").alias("kept"))
    gone = hit.where("not is_first").join(first, "h").where("chunk = kept").select("key", "s", "e")
    gone = gone.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(s, e - 1)"))))).alias("gone"))
    out = rows.join(gone, rows["__key"] == gone["key"], "left").drop("key")
    names = [c for c in out.columns if c not in ("__key", "gone", text_col)]
    quoted = [f"`{c}`" for c in names]
    out = _inline(out, [*quoted, f"`{text_col}` as __text", "gone"], __lines=f"split(`{text_col}`, '\n', -1)")
    # gone is sorted: what stays are the runs of lines between its members
    runs = "transform(sequence(0, size(gone)), k -> slice(__lines, coalesce(get(gone, k - 1), -1) + 2, coalesce(get(gone, k), size(__lines)) - coalesce(get(gone, k - 1), -1) - 1))"
    kept = f"if(gone is null, __text, array_join(flatten({runs}), '\n'))"
    return out.selectExpr(*[f"{kept} as `{text_col}`" if c == text_col else f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_removed", "__key")], "cast(if(__text is null, 0, size(__lines)) as long) as n_lines", "cast(if(gone is null, 0, size(gone)) as long) as n_removed")
