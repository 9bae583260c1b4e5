"""Text expressions: cleaning, formatting, tokens, redaction. All of them native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must equal the ones users already have.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have "
    "how i if in into is it its me my of on or our over should so such than that the "
    "their them then there these they this those to was we were what when where "
    "which who why will with would you your about tell explain me please give show"
).split()
TOKEN_PATTERN = r"[a-z0-9]+(?:\.[0-9]+)?"
MIN_STEM = 4
NOT_RECORDED = "not recorded in the dataset"
LAKH = 100_000
CRORE = 10_000_000
SECRET_PATTERN = (
    r"(?i)\b(token|secret|password|passwd|passphrase|credential|api[_-]?key|access[_-]?key"
    r"|service[_-]?role[_-]?key|publishable[_-]?key|anon[_-]?key|bearer)"
    r"(\s*[\"']?\s*[:=]\s*)([\"'][^\"'\n]{6,}[\"'])"
)
ASSIGNMENT_PATTERN = r"(?i)\b([A-Z][A-Z0-9_]*(?:TOKEN|KEY|SECRET|PASSWORD))\s*=\s*(\S{6,})"
SQL_OBJECT_PATTERN = (
    r"(?im)^\s*create\s+(?:or\s+replace\s+)?(table|view|policy|index|function)"
    r"\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"
)
JS_EXPORT_PATTERN = r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:function|const|class)\s+(\w+)"
JS_CONST_PATTERN = r"(?m)^const\s+([A-Z][A-Z0-9_]*)\s*="
JS_HEADER_PATTERN = r"(?s)^\s*/\*\*(.*?)\*/"

#: White space of any kind: control characters that break or separate, and every code point of Unicode's separators.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(_SPACE))


def says_something(c: Column) -> Column:
    """Whether there is anything but white space; false for NULL. Only what comes before it is looked at."""
    return F.coalesce(F.ltrim(c, F.lit(_SPACE)) != "", F.lit(False))


def clean_name(c: Column) -> Column:
    """A stripped name; a blank one is NULL."""
    return F.nullif(strip(c), F.lit(""))


def safe_float(c: Column) -> Column:
    """The number in a cell, or NULL where there is none."""
    text = strip(c)
    usable = text.rlike(_NUMBER) | text.rlike(_INFINITE)
    return F.when(usable, F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def type_label(types: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(types, "/"), F.lit("")), F.lit("unknown"))


def slug(c: Column) -> Column:
    """Lower-case letters and digits; everything else becomes a dash, end dashes go."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def number_text(value: Column, unit: str = "", decimals: int = 3) -> Column:
    """Grouped digits without trailing zeros, then the unit; or that nothing is recorded."""
    shown = F.format_number(value.cast("double"), decimals)
    if decimals > 0:
        shown = F.rtrim(F.rtrim(shown, F.lit("0")), F.lit("."))  # there is a point, so no zero before it is touched
    shown = F.concat(shown, F.lit(f" {unit}")) if unit else shown
    present = value.isNotNull() & ~F.isnan(value.cast("double"))
    return F.when(present, shown).otherwise(F.lit(NOT_RECORDED))


def indian_scale(value: Column) -> Column:
    """' (about Rs. 32.33 lakh)' from a lakh upward, blank below it or without a value."""
    v = value.cast("double")
    size = F.abs(v)

    def about(unit: int, word: str) -> Column:
        return F.concat(F.lit(" (about Rs. "), F.format_number(v / unit, 2), F.lit(f" {word})"))

    return (
        F.when(value.isNull() | F.isnan(v), "")
        .when(size >= CRORE, about(CRORE, "crore"))
        .when(size >= LAKH, about(LAKH, "lakh"))
        .otherwise("")
    )


def chain_text(stops: Column) -> Column:
    return F.array_join(stops, " -> ")


def wrapped_chain(stops: Column, width: int = 72) -> Column:
    """The chain as lines of at most `width`, broken only at an arrow that stays on its line."""
    start = F.struct(
        F.array().cast("array<string>").alias("lines"), F.lit("").alias("current"))

    def add(acc: Column, name: Column) -> Column:
        fits = F.length(acc.current) + F.length(name) + 4 <= width
        return (
            F.when(acc.current == "", F.struct(acc.lines.alias("lines"), name.alias("current")))
            .when(fits, F.struct(acc.lines.alias("lines"),
                                 F.concat(acc.current, F.lit(" -> "), name).alias("current")))
            .otherwise(F.struct(
                F.array_append(acc.lines, F.concat(acc.current, F.lit(" ->"))).alias("lines"),
                name.alias("current")))
        )

    def close(acc: Column) -> Column:
        return F.when(acc.current != "", F.array_append(acc.lines, acc.current)).otherwise(acc.lines)

    return F.aggregate(stops, start, add, close)


def stem(token: Column) -> Column:
    """Strip one plural or tense ending, then a closing e, while a real word remains.

    Only the number of characters to drop is decided by the cases, so the token is
    cut once and the expression stays cheap in generated code.
    """
    n = F.length(token)

    def ends(suffix: str) -> Column:
        return token.endswith(suffix) & (n >= len(suffix) + MIN_STEM)

    plural_y = ends("ies")
    ending = (
        F.when(ends("ings"), 4).when(ends("ing"), 3).when(ends("es") | ends("ed"), 2).when(ends("s"), 1).otherwise(0))
    left = n - ending
    closing = F.when((left > MIN_STEM) & (F.substring(token, left, F.lit(1)) == "e"), 1).otherwise(0)
    short = (
        F.when(plural_y, F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .otherwise(F.substring(token, F.lit(1), left - closing)))
    return F.when((n > MIN_STEM) & token.rlike("^[a-z]+$"), short).otherwise(token)


def raw_tokens(text: Column) -> Column:
    """Lower-case word and number tokens without stop words, not yet stemmed."""
    plain = F.replace(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), F.lit("->"), F.lit(" "))
    return F.filter(
        F.regexp_extract_all(plain, F.lit(TOKEN_PATTERN), 0), lambda t: ~t.isin(STOPWORDS))


def tokenize(text: Column) -> Column:
    return F.transform(raw_tokens(text), stem)


def redact(text: Column) -> Column:
    """Blank assigned secrets; the names they were assigned to stay."""
    quoted = F.regexp_replace(text, SECRET_PATTERN, '$1$2"<redacted>"')
    return F.regexp_replace(quoted, ASSIGNMENT_PATTERN, "$1=<redacted>")


def clip_text(text: Column, limit: int, marker: str) -> Column:
    """Cut after `limit` characters, drop the white space left at the end, add the marker."""
    cut = F.rtrim(F.substring(text, 1, limit), F.lit(_SPACE))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(marker))).otherwise(text)


def header_comment(text: Column) -> Column:
    """The opening block comment of a script, its decoration removed."""
    block = F.regexp_extract(text, JS_HEADER_PATTERN, 1)
    lines = F.transform(
        F.split(block, r"\r\n|\r|\n"),
        lambda line: strip(F.regexp_replace(strip(line), r"^\*+", "")))
    return strip(F.array_join(lines, "\n"))


def leading_dashes(text: Column) -> Column:
    """The run of ``--`` comment lines a SQL file opens with; blank lines may stand between."""
    block = F.regexp_extract(text, r"\A((?:(?:--[^\n]*|[ \t\r]*)(?:\n|\z))*)", 1)
    lines = F.filter(F.split(block, "\n"), lambda line: line.startswith("--"))
    return F.array_join(
        F.transform(lines, lambda line: F.rtrim(F.regexp_replace(line, "^[- ]+", ""), F.lit(_SPACE))), "\n")
