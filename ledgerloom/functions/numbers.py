"""Amounts as text: parsers, predicates, formats and unit conversion.

The parsers differ on purpose in how they read blanks, dashes, triangles and
stray letters; every operator names the one it depends on.  All of them are
plain Column expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip

# Fixed values
DASHES = ("-", "–", "—")
BACKSLASH = "\\"
UNIT_WON = {"won": 1, "thousand": 1_000, "million": 1_000_000}
CURRENCY_OR_SPACE = r"[₩$€¥£\s,]"

AMOUNT = "decimal(38,6)"
WHOLE = "decimal(38,0)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


PAREN = r"(?s)^\((.*)\)$"


def _in_parens(c: Column) -> Column:
    return c.startswith("(") & c.endswith(")")


def _unbracket(c: Column) -> Column:
    return F.when(_in_parens(c), c.substr(F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def _signed(value: Column, negative: Column) -> Column:
    return F.when(negative, -value).otherwise(value)


def _drop(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def parse_source_amount(text) -> Column:
    """Won marks dropped, blanks and dashes zero, ``(x)`` and ``-x`` negative; empty is NULL."""
    text = _col(text)
    t = strip(_drop(text, BACKSLASH + "₩"))
    body = _drop(strip(F.regexp_replace(t, PAREN + "|^-", "$1")), ",")
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(t.isin("", *DASHES), F.lit(0).cast(AMOUNT))
        .when(body.rlike(r"\.|^\s*[+-]?[0-9]+\s*$"), _signed(body.try_cast(AMOUNT), t.rlike(PAREN + "|^-")))
    )


def _parse_loose(text, zeros: tuple[str, ...]) -> Column:
    t = strip(_col(text))
    body = F.regexp_replace(_unbracket(t), CURRENCY_OR_SPACE, "")
    return F.when(t.isin(*zeros) | (body == ""), F.lit(0).cast(AMOUNT)).otherwise(
        _signed(body.try_cast(AMOUNT), _in_parens(t))
    )


def parse_cell_number(text) -> Column:
    """Currency, commas and spaces dropped; blank and dash are zero; backslash is no number."""
    return _parse_loose(text, ("", *DASHES))


def parse_cell_number_or_placeholder(text) -> Column:
    """As :func:`parse_cell_number`, a lone backslash also being zero."""
    return _parse_loose(text, ("", *DASHES, BACKSLASH))


def _parse_whole(text, drop_leading_backslash: bool) -> Column:
    t = strip(_col(text))
    u = _drop(F.regexp_replace(_unbracket(t), "^[△▲]", ""), ", \u00a0")
    if drop_leading_backslash:
        u = strip(F.ltrim(u, F.lit(BACKSLASH)))
    negative = t.rlike(r"(?s)^\(.*\)$|^[△▲]") | u.startswith("-")
    v = F.floor(F.regexp_replace(u, "^-", "").try_cast(AMOUNT)).cast("decimal(30,0)")
    sign = F.when(negative, -1).otherwise(1).cast("decimal(1,0)")
    return F.when(t.isin("", *DASHES, BACKSLASH, "/"), F.lit(0).cast(WHOLE)).otherwise((v * sign).cast(WHOLE))


def parse_whole(text) -> Column:
    """Whole amounts: triangles and parentheses negative, fraction cut, blank marks zero."""
    return _parse_whole(text, True)


def parse_whole_strict(text) -> Column:
    """As :func:`parse_whole` without forgiving a leading backslash."""
    return _parse_whole(text, False)


def number_signature(text) -> Column:
    """Normalised number string used as a join key; anything but digits, dot, minus is dropped."""
    t = strip(_col(text))
    digits = F.regexp_replace(_unbracket(t), r"[^0-9.\-]", "")
    v = _signed(digits.try_cast(AMOUNT), _in_parens(t))
    shown = F.regexp_replace(v.cast("string"), r"\.?0+$", "")
    return F.when(t.isin("", *DASHES) | (digits == ""), None).otherwise(shown)


def _parse_report(text, percent: str) -> Column:
    text = _col(text)
    t = strip(_drop(text, BACKSLASH + "₩"))
    minus = r"^-(?=\s*[0-9.,]*[0-9][0-9.,]*$)"
    body = _drop(strip(F.regexp_replace(t, PAREN + "|" + minus, "$1")), ",")
    pct = _drop(strip(_drop(t, "%")), ",").try_cast(AMOUNT) if percent == "value" else F.lit(None).cast(AMOUNT)
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(t.isin("", *DASHES), F.lit(0).cast(AMOUNT))
        .when(t.contains("%"), pct)
        .when(t.rlike(r"^[A-Za-z\s]+$"), None)
        .when(body.rlike(r"\.|^\s*[+-]?[0-9]+\s*$"), _signed(body.try_cast(AMOUNT), t.rlike(PAREN + "|" + minus)))
    )


def parse_report_number(text) -> Column:
    """Numbers of an English report; percentages are not amounts."""
    return _parse_report(text, "null")


def parse_report_number_or_percent(text) -> Column:
    """As :func:`parse_report_number`, a percentage giving its own value."""
    return _parse_report(text, "value")


def looks_numeric(text) -> Column:
    """Blank, dash, or a number once brackets, currency and commas are gone."""
    t = strip(_col(text))
    body = F.regexp_replace(F.regexp_replace(t, r"^[()]+|[()]+$", ""), CURRENCY_OR_SPACE, "")
    return t.isin("", *DASHES) | (body == "") | body.try_cast(AMOUNT).isNotNull()


def has_amount(text) -> Column:
    """:func:`looks_numeric` with a real value behind it."""
    t = strip(_col(text))
    return ~t.isin("", *DASHES, BACKSLASH) & looks_numeric(t)


def is_amount_cell(text) -> Column:
    """A cell that may take an amount: only digits and number marks, or empty."""
    t = strip(_col(text))
    return t.isin("", "/", *DASHES, BACKSLASH) | F.translate(t, ",()-\\ △▲", "").rlike(r"^[0-9]*(\.*[0-9]+\.*)*$")


def is_template_number(text) -> Column:
    """Template number test: dash yes, blank no, one decimal point at most."""
    t = strip(_drop(_col(text), "," + BACKSLASH + "₩"))
    body = strip(_unbracket(t))
    return t.isin(*DASHES) | ((t != "") & body.rlike(r"^-*([0-9]+\.?[0-9]*|\.[0-9]+)$"))


def is_number_text(text) -> Column:
    """Nothing but digits, brackets, dashes, separators and percent signs."""
    return strip(_col(text)).rlike(r"^[\s()\-–—,.0-9%]*$")


def is_label_cell(text) -> Column:
    """A non-empty, non-numeric text that must not be overwritten with an amount."""
    t = strip(_col(text))
    clean = F.translate(t, ",()-\\ ", "")
    return (t != "") & (clean != "") & ~clean.rlike(r"^\.*[0-9][0-9.]*$")


def format_amount(value) -> Column:
    """Template notation: dash for zero and NULL, brackets for negatives."""
    v = _col(value)
    shown = F.format_number(F.abs(v), 0)
    return F.when(v.isNull() | (v == 0), "-").when(v < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def format_report_number(value, decimals: int = 0, negative_style: str = "parentheses") -> Column:
    """English report notation: empty for NULL, dash for zero, brackets or minus."""
    v = _col(value)
    shown = F.format_number(F.abs(v), decimals)
    neg = F.concat(F.lit("("), shown, F.lit(")")) if negative_style == "parentheses" else F.concat(F.lit("-"), shown)
    return F.when(v.isNull(), "").when(v == 0, "-").when(v < 0, neg).otherwise(shown)


def number_format(text) -> Column:
    """Notation used in a text sample, as a struct."""
    t = _col(text)
    return F.struct(
        F.when(t.contains(","), ",").otherwise("").alias("thousands_separator"),
        F.when(t.rlike(r"\([0-9]"), "parentheses").otherwise("minus").alias("negative_style"),
        F.when(t.rlike(r"(^|[^\p{L}\p{N}_])-($|[^\p{L}\p{N}_])"), "dash").otherwise("zero").alias("zero_style"),
        (t.contains(BACKSLASH) | t.contains("₩")).alias("has_won_symbol"),
        t.rlike(r"[0-9]\.[0-9]").alias("has_decimals"),
    )


def unit_factor(unit, default: int = 1_000) -> Column:
    """Won per unit; unknown units count as ``default``."""
    u = _col(unit)
    out = F.lit(default)
    for name, won in UNIT_WON.items():
        out = F.when(u == name, won).otherwise(out)
    return F.when(u.isNull(), default).otherwise(out).cast("bigint")


def convert_unit(value, from_unit, to_unit) -> Column:
    """Amount in another unit, halves rounded away from zero."""
    v = _col(value).cast(WHOLE)
    won = v * unit_factor(from_unit).cast("decimal(10,0)")
    return F.round(won / unit_factor(to_unit).cast("decimal(10,0)"), 0).cast("bigint")


def unit_of_source_text(text, body: bool = False) -> Column:
    """Unit named by one source cell; headers and body rows are read in different order."""
    t = strip(_col(text))
    rules = [(t.contains("천원"), "thousand"), (t.contains("백만원"), "million")]
    won = t.rlike(r"단위\s*[:：]\s*원") if body else t.contains("원")
    rules = [(won, "won"), *rules] if body else [*rules, (won, "won")]
    out = F.when(rules[0][0], rules[0][1])
    for cond, unit in rules[1:]:
        out = out.when(cond, unit)
    return out


def unit_of_template_text(text) -> Column:
    """Unit named by one template cell."""
    t = F.lower(strip(_col(text)))
    return (
        F.when(t.contains("in thousands"), "thousand")
        .when(t.contains("in millions"), "million")
        .when(t.contains("in korean won") | t.contains("korean won)"), "won")
    )


def amounts_match(expected, actual, tolerance: int = 1) -> Column:
    """Equal within the tolerance; a missing side equals a missing or zero other side."""
    e, a = _col(expected), _col(actual)
    return (
        F.when(e.isNull() & a.isNull(), True)
        .when(e.isNotNull() & a.isNotNull(), F.abs(e - a) <= tolerance)
        .otherwise(F.coalesce(e, a) == 0)
    )
