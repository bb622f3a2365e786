"""From element and paragraph rows to documents, sections and notes.

Elements:   doc_id, seq, tag, attrs, text   (document order)
Paragraphs: doc_id, seq, style, text
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators.sequence import carry_last, preceding, running_sum

# Fixed values
PREAMBLE = "(서문)"
COMPANY_MARK = "주식회사"
COMPANY_SUFFIXES = ["co., ltd.", "co., ltd", "inc.", "corp.", "corporation"]
AUDIT_WORDS = ["감사인", "감사보고서", "내부회계", "외부감사"]
UNIT_PATTERN = r"(\(단위\s*:\s*[^)]+\))"
SKIPPED_TAGS = ["title", "insertion", "comment", "library", "librarylist", "warning"]
SUBTITLE_STYLES = ["aff5", "subtitle"]


def document_type(name) -> Column:
    """consolidated or separate, from the document name."""
    return F.when(F.col(name).contains("연결"), "consolidated").otherwise("separate")


def company_name(elements: DataFrame, name_tag: str = "company-name", cell_tag: str = "td",
                 cell_mark: str = "F-14|BT14", paragraph_tag: str = "p", marker: str = COMPANY_MARK) -> DataFrame:
    """The company: its own tag, else a marked cell, else a short paragraph with the company marker."""
    t = tx.strip("text")
    squeezed = F.regexp_replace(t, r"\s+", " ")

    def first(cond: Column) -> Column:
        return F.min_by(squeezed, F.when(cond & (t != ""), F.col("seq")))

    marked = (F.col("tag") == cell_tag) & F.col("attrs").rlike(cell_mark) & (t.contains(marker) | (F.length(t) > 3))
    return elements.groupBy("doc_id").agg(
        F.coalesce(first(F.col("tag") == name_tag), first(marked),
                   first((F.col("tag") == paragraph_tag) & t.contains(marker) & (F.length(t) < 50))).alias("company"))


def report_years(dated: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Current and prior year: the two latest distinct years; a single year implies the one before."""
    years = dated.select(*keys, F.col(year).cast("int").alias("y")).where("y is not null").distinct()
    top = years.groupBy(*keys).agg(F.max("y").alias("cur"))
    second = years.join(top, keys).where("y < cur").groupBy(*keys).agg(F.max("y").alias("pri"))
    return top.join(second, keys, "left").select(
        *keys, F.col("cur").cast("string").alias("period_current"), F.coalesce("pri", F.col("cur") - 1).cast("string").alias("period_prior"))


def template_metadata(lines: DataFrame, within: int | None = None, company_within: int | None = None) -> DataFrame:
    """Company, type and years of a template from its paragraphs, the earliest that tells each.

    ``lines``: doc_id, seq (from 0), style, text, file_name. ``within`` and ``company_within`` look at so many first paragraphs only.
    """
    head = (lines if within is None else lines.where(F.col("seq") < within)).withColumn("t", tx.strip("text"))
    low = F.lower("t")
    cuts = [F.when(F.instr(low, s) > 0, F.rtrim(F.trim(F.substring("t", F.lit(1), F.instr(low, s) + len(s) - 1)), F.lit(","))) for s in COMPANY_SUFFIXES]
    legal = F.coalesce(*cuts)
    plain = (F.col("style") == "Normal") & (F.col("t") != "") & (F.length("t") < 80) & ~F.col("t").startswith("(")
    candidate = F.coalesce(legal, F.when(plain, F.col("t")))
    both = r"(?i)December\s+31,\s+([0-9]{4})\s+and\s+([0-9]{4})"
    y1, y2 = (F.regexp_extract("t", both, i).try_cast("int") for i in (1, 2))
    years = F.transform(F.regexp_extract_all("t", F.lit(r"\b(20[12][0-9])\b"), 1), lambda y: y.cast("int"))
    early = F.lit(True) if company_within is None else F.col("seq") < company_within
    g = head.groupBy("doc_id").agg(
        # a legal suffix in a later line beats a plain first line only while no line was taken yet
        F.min_by(candidate, F.when(early & legal.isNotNull(), F.col("seq"))).alias("legal"),
        F.min(F.when(early & legal.isNotNull(), F.col("seq"))).alias("legal_seq"),
        F.min_by(candidate, F.when(early & legal.isNull() & plain, F.col("seq"))).alias("plain"),
        F.min(F.when(early & legal.isNull() & plain, F.col("seq"))).alias("plain_seq"),
        F.max(low.contains("consolidated")).alias("con"), F.max(low.contains("separate")).alias("sep"),
        F.min_by(F.struct(F.greatest(y1, y2).alias("c"), F.least(y1, y2).alias("p")), F.when(F.col("t").rlike(both), F.col("seq"))).alias("z"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(years))), asc=False).alias("ys"),
        F.first("file_name").alias("file_name"))
    file_low = F.lower("file_name")
    use_legal = F.col("legal_seq").isNotNull() & (F.col("plain_seq").isNull() | (F.col("legal_seq") < F.col("plain_seq")))
    stem = F.regexp_extract("file_name", r"^([^_ .]*)", 1)
    kind = (F.when(F.col("con"), "consolidated").when(F.col("sep"), "separate")
            .when(file_low.contains("별도") | file_low.contains("separate"), "separate")
            .when(file_low.contains("연결") | file_low.contains("consolidat"), "consolidated"))
    cur = F.coalesce("z.c", F.get("ys", 0))
    pri = F.when(F.col("z").isNotNull(), F.col("z.p")).otherwise(F.get("ys", 1))
    return g.select("doc_id", F.when(use_legal, F.col("legal")).otherwise(F.coalesce("plain", stem)).alias("company"),
                    kind.alias("doc_type"), cur.cast("string").alias("period_current"), pri.cast("string").alias("period_prior"))


def open_ancestors(elements: DataFrame, tags: list[str]) -> DataFrame:
    """Add ``in_<tag>``: how many elements of that tag are open around each element."""
    out = elements
    for tag in tags:
        step = F.when(F.col("tag") == tag, 1).when(F.col("tag") == f"/{tag}", -1).otherwise(0)
        out = running_sum(out, ["doc_id"], "seq", step, f"in_{tag}", inclusive=False)
    return out


def content_elements(elements: DataFrame, content: list[str], skipped: list[str]) -> DataFrame:
    """Content elements in document order, without those inside skipped parts."""
    walked = open_ancestors(elements, skipped)
    clear = reduce(lambda a, b: a & b, [F.col(f"in_{t}") <= 0 for t in skipped])
    return walked.where(F.col("tag").isin(*content) & clear).drop(*[f"in_{t}" for t in skipped])


def split_sections(elements: DataFrame, outer: str, inner: str) -> DataFrame:
    """Elements of the outer section are statements, those of nested inner ones are notes; none is both."""
    w = open_ancestors(elements, [outer, inner])
    part = F.when(F.col(f"in_{inner}") > 0, "notes").when(F.col(f"in_{outer}") > 0, "statements")
    return w.withColumn("part", part).where("part is not null").drop(f"in_{outer}", f"in_{inner}")


def segment_notes(lines: DataFrame) -> DataFrame:
    """Paragraphs under their notes: a top-level number opens a note.

    Text before the first note is note ``0``, kept only if it has a paragraph.
    """
    n = lines.withColumn("t", tx.strip("text")).where("t <> ''").withColumn("n", tx.note_numbering("t"))
    n = n.withColumn("opens", F.coalesce(F.col("n.depth") == 0, F.lit(False)))
    s = running_sum(n, ["doc_id"], "seq", F.when(F.col("opens"), 1).otherwise(0), "note_idx")
    s = carry_last(s, ["doc_id"], "seq", F.when(F.col("opens"), F.struct(F.col("n.number").alias("number"), F.col("n.title").alias("title"))), "head")
    kind = F.when(F.col("opens"), "title").when(F.col("n").isNotNull(), "subtitle").otherwise("paragraph")
    s = s.withColumn("elem_type", kind)
    bare = s.where("note_idx = 0").groupBy("doc_id").agg(F.max(F.col("elem_type") == "paragraph").alias("keep")).where("not keep")
    numbering = F.when(F.col("opens"), None).when(
        (F.col("n.depth") == 1) & F.col("n.number").rlike("^[0-9]+$"), F.concat(F.lit("("), F.col("n.number"), F.lit(")"))).otherwise(F.col("n.number"))
    empty_preamble = bare.select("doc_id", F.lit(0).cast("bigint").alias("note_idx"))
    return s.join(empty_preamble, ["doc_id", "note_idx"], "left_anti").select(
        "doc_id", "seq", "note_idx", F.coalesce("head.number", F.lit("0")).alias("number"), F.coalesce("head.title", F.lit(PREAMBLE)).alias("title"),
        "elem_type", numbering.alias("numbering"), F.coalesce("n.depth", F.lit(0)).cast("bigint").alias("depth"))


def is_title_style(style: str, expected: str = "ABCTitle") -> Column:
    return F.lower(style) == expected.lower()


def is_subtitle_style(style: str, expected: str = "Subtitle") -> Column:
    return F.lower(style).isin(expected.lower(), *SUBTITLE_STYLES)


def segment_sections(lines: DataFrame, title_style: str = "ABCTitle", subtitle_style: str = "Subtitle") -> DataFrame:
    """Template paragraphs under their sections: title style opens one, closing sentences and blanks do not."""
    styled = is_title_style("style", title_style)
    opens = styled & (tx.strip("text") != "") & ~tx.is_statement_footer("text")
    n = lines.withColumn("opens", opens).where(~(styled & (tx.strip("text") == "")))
    s = running_sum(n, ["doc_id"], "seq", F.when(F.col("opens"), 1).otherwise(0), "section_idx")
    s = s.withColumn("h", F.when(F.col("opens"), tx.note_number("text", F.col("section_idx"))))
    s = carry_last(s, ["doc_id"], "seq", F.col("h"), "head")
    kind = F.when(F.col("opens"), "title").when(is_subtitle_style("style", subtitle_style), "subtitle").otherwise("paragraph")
    return s.select("doc_id", "seq", "section_idx", F.when(F.col("section_idx") == 0, "preamble").otherwise("notes").alias("section_type"),
                    "head.number", F.coalesce(F.when(F.col("head.title") != "", F.col("head.title")), F.lit("Preamble")).alias("title"), kind.alias("elem_type"))


def preceding_unit(lines: DataFrame) -> DataFrame:
    """The unit note in force before each paragraph."""
    hit = F.regexp_extract("text", UNIT_PATTERN, 1)
    return carry_last(lines, ["doc_id"], "seq", F.when(hit != "", hit), "unit", inclusive=False)


def title_context(lines: DataFrame, count: int = 10) -> DataFrame:
    """Text of the up to ten siblings before each element."""
    marked = lines.withColumn("_t", F.trim(F.replace("text", F.lit("&cr;"), F.lit(" "))))
    w = preceding(marked, ["doc_id"], "seq", "_t", count, "_p")
    return w.withColumn("context", F.array_join(F.filter("_p", lambda x: x != ""), " ")).drop("_t", "_p")


def nearest_paragraph(lines: DataFrame, limit: int = 60) -> DataFrame:
    """The nearest non-blank paragraph before each element, cut to ``limit`` characters."""
    t = tx.strip("text")
    return carry_last(lines, ["doc_id"], "seq", F.when(t != "", F.substring(t, 1, limit)), "context", inclusive=False)


def select_statement_tables(tables: DataFrame) -> DataFrame:
    """Framed tables with a head and five rows outside the notes, once each, audit sections left out.

    ``tables``: doc_id, table_id, border, has_head, n_rows, in_notes, section_title.
    """
    audit = reduce(lambda a, b: a | b, [F.col("section_title").contains(w) for w in AUDIT_WORDS])
    return tables.where((F.col("border") == 1) & F.col("has_head") & (F.col("n_rows") >= 5) & ~F.col("in_notes") & ~audit).dropDuplicates(["doc_id", "table_id"])
