"""Labels, titles, numbering, addresses and model answers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
SPACE = "[\\s\u00a0\u3000]"
BLANKS = " \t\n\r\x0b\x0c\u00a0\u3000"
KOREAN = r"[가-힯㄰-㆏]"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
KOREAN_LETTERS = "가나다라마바사아자차카타파하"
MIDDLE_MARK = "\n...(중략)...\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(BLANKS))


def clean_lines(c) -> Column:
    """Marked and real line breaks kept, inner spaces collapsed, blank lines dropped."""
    lines = F.split(F.replace(_col(c), F.lit("&cr;"), F.lit("\n")), "\n")
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_label(c) -> Column:
    """Lower case, trailing punctuation dropped, spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[\s:;,.\-–—]+$", ""), r"\s+", " ")


def normalize_title(c) -> Column:
    """Leading ``N.`` or ``N)`` dropped, spaces collapsed, lower case."""
    t = F.regexp_replace(strip(c), r"^[0-9]+[.)]\s*", "")
    return strip(F.lower(F.regexp_replace(t, r"\s+", " ")))


def clean_label(c) -> Column:
    """Leading numbering, circled numbers included, dropped."""
    return strip(F.regexp_replace(strip(c), r"^[0-9.)(①②③④⑤⑥⑦⑧⑨⑩\s]+", ""))


def bare_title(c) -> Column:
    """Title without its number prefix."""
    return strip(F.regexp_replace(strip(c), r"^[0-9.\s\-–—]+", ""))


def normalize_number(c) -> Column:
    """Note number without trailing dots and leading zeros; ``2.1`` stays."""
    n = F.regexp_replace(strip(c), r"\.+$", "")
    bare = F.regexp_replace(n, r"^0+", "")
    return F.when(n.contains("."), n).when(bare == "", "0").otherwise(bare)


def is_korean(c) -> Column:
    return _col(c).rlike(KOREAN)


def is_english(c) -> Column:
    return _col(c).rlike("[a-zA-Z]")


def word_tokens(c) -> Column:
    """Distinct lower-case Latin words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z]+)"), 1))


def label_tokens(c) -> Column:
    """Distinct blank-separated tokens of a normalised label."""
    return F.array_distinct(F.filter(F.split(_col(c), r"\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 when a side is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)).cast("double"))


def containment(a: Column, b: Column, base: float, weight: float) -> Column:
    """``base + weight * shorter/longer`` when one text holds the other, else NULL."""
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    return F.when(a.contains(b) | b.contains(a), base + weight * (F.least(la, lb) / F.greatest(la, lb)))


def with_label_similarity(df: DataFrame, a: str, b: str, out: str, read_a: str | None = None, read_b: str | None = None) -> DataFrame:
    """Add the similarity in [0, 1] of the row labels ``a`` and ``b`` as ``out``.

    ``read_*`` names the column with the dictionary reading of a Korean label
    (NULL if none); it lets a Korean label meet an English one.
    """
    tmp = {"_na": normalize_label(a), "_nb": normalize_label(b)}
    for name, read in (("_ra", read_a), ("_rb", read_b)):
        if read:
            tmp[name] = normalize_label(read)
    df = df.withColumns(tmp)
    df = df.withColumns({k.replace("_", "_t"): label_tokens(k) for k in tmp})
    na, nb = F.col("_na"), F.col("_nb")
    cross = F.lit(None).cast("double")
    for ko, en, read, e in ((a, b, "_ra", "_nb"), (b, a, "_rb", "_na")):
        if read not in tmp:
            continue
        t, e = F.col(read), F.col(e)
        j = jaccard(F.col(read.replace("_", "_t")), F.col("_tnb" if ko == a else "_tna"))
        sim = F.when(t == e, 0.95).otherwise(F.coalesce(containment(t, e, 0.7, 0.25), F.when(j >= 0.3, 0.6 + 0.3 * j)))
        usable = is_korean(ko) & ~is_korean(en) & (t != "") & (e != "")
        cross = F.coalesce(cross, F.when(usable, sim))
    known = (
        F.when((na == "") | (nb == "") | na.isNull() | nb.isNull(), 0.0)
        .when(na == nb, 1.0)
        .otherwise(F.coalesce(containment(na, nb, 0.7, 0.3), cross, jaccard(F.col("_tna"), F.col("_tnb"))))
    )
    return df.withColumn(out, known).drop(*tmp, *[k.replace("_", "_t") for k in tmp])


def note_numbering(c) -> Column:
    """(number, title, depth) of a numbered paragraph, NULL otherwise."""
    t = strip(c)
    rules = [  # fixed values: pattern and depth, in order of precedence
        (r"^([0-9]+)\.\s+([\s\S]+)", 0),
        (r"^([0-9]+\.[0-9]+\.[0-9]+)\s+([\s\S]+)", 2),
        (r"^([0-9]+\.[0-9]+)\s+([\s\S]+)", 1),
        (r"^\(([0-9]+)\)\s+([\s\S]+)", 1),
        (rf"^([{CIRCLED}])\s*([\s\S]+)", 2),
        (rf"^([{KOREAN_LETTERS}])\.\s+([\s\S]+)", 2),
    ]
    out = None
    for pattern, depth in rules:
        raw = F.regexp_extract(t, pattern, 1)
        pos = F.instr(F.lit(CIRCLED), raw) if CIRCLED in pattern else F.lit(0)
        number = F.when((raw != "") & (pos > 0), pos.cast("string")).otherwise(raw) if CIRCLED in pattern else raw
        item = F.struct(
            number.alias("number"),
            strip(F.regexp_extract(t, pattern, 2)).alias("title"),
            F.lit(depth).cast("bigint").alias("depth"),
        )
        out = F.when(t.rlike(pattern), item) if out is None else out.when(t.rlike(pattern), item)
    return out


def note_number(c, fallback) -> Column:
    """(number, title) of a template title, numbered by ``fallback`` when it has none."""
    t = strip(c)
    pattern = r"^([0-9]+(\.[0-9]+)*)\s*\.?\s+([^\n]+)$"
    return F.when(
        t.rlike(pattern),
        F.struct(F.regexp_extract(t, pattern, 1).alias("number"), strip(F.regexp_extract(t, pattern, 3)).alias("title")),
    ).otherwise(F.struct(_col(fallback).cast("string").alias("number"), t.alias("title")))


def is_statement_footer(c) -> Column:
    """Closing sentences set in title style, or text too long to be a title."""
    t = F.lower(strip(c))
    return (
        t.contains("should be read in conjunction")
        | (t.contains("the above") & t.contains("statement"))
        | (F.length(t) > 120)
    )


def statement_type(c) -> Column:
    """BS, IS, CE or CF named by a title; the first family that hits wins."""
    t = F.lower(_col(c))
    families = [  # fixed values
        ("BS", ["balance", "financial position", "재무상태"]),
        ("IS", ["income", "comprehensive", "profit", "손익"]),
        ("CE", ["equity", "자본변동"]),
        ("CF", ["cash", "현금"]),
    ]
    out = None
    for code, words in families:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def indent_level(c) -> Column:
    """Indent 0..3 from leading white space."""
    t = _col(c)
    lead = F.length(t) - F.length(F.regexp_replace(t, rf"^{SPACE}+", ""))
    return F.when(lead >= 6, 3).when(lead >= 4, 2).when(lead >= 2, 1).otherwise(0).cast("bigint")


def indent_level_of_offset(c) -> Column:
    """Indent from a left offset, 360 units per level."""
    return F.floor(_col(c) / 360).cast("bigint")


def is_subtotal_text(c) -> Column:
    return _col(c).rlike(r"소\s*계")


def is_total_text(c) -> Column:
    return _col(c).rlike(r"합\s*계|총\s*계") & ~is_subtotal_text(c)


def parse_address(c) -> Column:
    """``table:5:row:3`` as a map of strings; a bare word maps to ``true``."""
    parts = F.split(_col(c), ":")
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(parts) - 1) / 2).cast("int"))),
        lambda i: F.struct(F.get(parts, i * 2).alias("k"), F.coalesce(F.get(parts, i * 2 + 1), F.lit("true")).alias("v")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["k"] != ""))


def address_part(c, key: str) -> Column:
    """One whole-number part of an address, NULL when absent or not a number."""
    return F.regexp_extract(_col(c), rf"(?:^|:){key}:([0-9]+)(?::|$)", 1).try_cast("bigint")


def coerce_argument(value, expected: str) -> Column:
    """A textual argument in its declared type, shown as text; unconvertible input passes through."""
    v = _col(value)
    if expected == "integer":
        return F.coalesce(F.when(strip(v).rlike(r"^[+-]?[0-9]+$"), strip(v).try_cast("bigint").cast("string")), v)
    if expected == "number":
        return F.coalesce(v.try_cast("double").cast("string"), v)
    if expected == "boolean":
        return F.when(v.isNull(), None).otherwise(F.lower(v).isin("true", "1", "yes").cast("string"))
    return v


def json_list(c) -> Column:
    """Strings of a model answer: fenced JSON array, bare array, or (numbered) lines."""
    t = strip(c)
    arr = T.ArrayType(T.StringType())
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(x), '^"+|"+$', ""), "^'+|'+$", ""), ",+$", "")
    lines = F.filter(F.split(t, "\n"), lambda x: strip(x) != "")
    lines = F.transform(lines, lambda x: F.regexp_replace(bare(x), r"^[0-9]+\.\s*(?=.)", ""))
    return (
        F.when(fenced != "", F.from_json(fenced, arr))
        .when(t.startswith("["), F.from_json(t, arr))
        .when(t.contains("\n"), lines)
    )


def json_action(c) -> Column:
    """The ``action`` of a model answer: whole text, fenced block, or first brace block; else ``_retry``."""
    t = _col(c)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    blocks = F.regexp_extract_all(t, F.lit(r"(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})"), 1)
    actions = F.transform(blocks, lambda b: F.get_json_object(b, "$.action"))
    return F.coalesce(
        F.get_json_object(strip(t), "$.action"),
        F.get_json_object(fenced, "$.action"),
        F.get(F.filter(actions, lambda a: a.isNotNull()), 0),
        F.lit("_retry"),
    )


def fit_list(items: Column, size: int, filler: Column) -> Column:
    """Exactly ``size`` entries: padded with ``filler`` or cut."""
    return F.slice(F.concat(F.coalesce(items, F.array().cast("array<string>")), F.array_repeat(filler, size)), 1, size)


def cut_middle(c, limit: int = 500) -> Column:
    """Long text as head, mark and tail."""
    t, half = _col(c), limit // 2
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(half)), F.lit(MIDDLE_MARK), F.right(t, F.lit(half)))).otherwise(t)


def cut_end(c, limit: int, mark: str = "") -> Column:
    """Long text cut at ``limit`` characters, then ``mark``."""
    t = _col(c)
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit(mark))).otherwise(t)


def has_extension(name, extensions: list[str]) -> Column:
    """File name ends in one of the extensions, any case."""
    return F.lower(F.regexp_extract(_col(name), r"(\.[^./]+)$", 1)).isin(*extensions)
