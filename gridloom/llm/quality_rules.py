"""Quality rules: a threshold table compiled into projections of length, symbol, stop-word and line ratios.

Everything is column expressions over one row: no user functions, no shuffle.

Defined results
    null or empty text      no words, every count 0, `base_failed` and therefore not kept
    very long text          measured whole; the work grows as n log n with its words
    repeated rows           each row is measured on its own
    empty table             an empty result with the same schema
    null in other columns   passed through
    other languages         a text of 30 words or more in a language without the words of STOP_WORDS
                            (Russian, Greek, Polish, Turkish ...) fails `stop_words` and is not kept
    clashing column names   input columns live in one struct, so none clashes with a measure
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: the space and U+0009 to U+000D.
GAPS = "[\\x20\\x09-\\x0D]+"
WORD_CHARACTER = "[^\\x20\\x09-\\x0D]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = (
    "the of and to in a is that for on with as it was by at from this be are an or not "
    "el la de que y en los las del un una por con para se su al lo es no "
    "le les des et une dans pour qui est sur par au du il ne pas "
    "der die das und ist von den mit zu im für auf ein eine nicht sich dem auch als").split()


@dataclass(frozen=True)
class Rule:
    """A document with at least `from_words` words fails when `100 * part` leaves `[least, most] * whole`."""

    name: str
    part: str
    whole: str
    least: int = 0
    most: int | None = None
    from_words: int = 0


#: Ratios in per cent of `whole`; `None` means without an upper bound.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("capitals", "n_capitals", "word_chars", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=2, from_words=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50, from_words=30),
)


def measured(df: DataFrame, text: str = "text", stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """(row, words counts ...): `row` is the input row as a struct, beside it the counts the rules use.

    Repeated windows are found by sorting their hashes within the row; windows
    whose hashes meet are compared by their words, so the count is exact.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), whole.alias("t"))
    split = base.select(
        "row", "t", F.array_remove(F.split("t", GAPS), "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD_CHARACTER)).alias("lines"))
    last = F.size("w") - F.lit(WINDOW - 1)
    hashes = F.when(last > 0, F.array_sort(F.transform(
        F.sequence(F.lit(1), last),
        lambda at: F.struct(F.xxhash64(F.slice("w", at, WINDOW)).alias("k"), at.alias("at")))))
    counted = split.select(
        "row", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
        "w", F.coalesce(hashes, F.expr("array()").cast("array<struct<k:bigint,at:int>>")).alias("h"))
    met = counted.withColumn("h", F.array_sort(F.transform(_twins("h"), lambda x: F.struct(
        F.array_join(F.slice("w", x["at"], WINDOW), " ").alias("k"), x["at"].alias("at"))))).drop("w")
    places = F.array_sort(F.transform(_twins("h"), lambda x: x["at"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        places, start,
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"])
    return met.withColumn("n_repeat_words", covered).drop("h")


def _twins(name: str) -> Column:
    """The entries of a sorted array of (k, at) whose k is also that of a neighbour."""
    return F.filter(name, lambda x, i: F.coalesce(
        x["k"] == F.get(F.col(name), i - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(F.col(name), i + 1)["k"], F.lit(False)))


def verdict(rules=RULES) -> Column:
    """The threshold table as one Boolean column: true if no rule fails."""
    good = F.lit(True)
    for rule in rules:
        part, whole = 100 * F.col(rule.part), F.col(rule.whole)
        fails = part < rule.least * whole
        if rule.most is not None:
            fails = fails | (part > rule.most * whole)
        good = good & ~(fails & (F.col("n_words") >= rule.from_words))
    return good


def judged(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`measured` with `base_failed` and `kept`."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return measured(df, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of `df` whose text passes, with their own columns.

    A plain filter would be pushed below the projections and repeat their array
    work in every reference; unfolding an array of one row or none is not.
    """
    one_or_none = judged(df, text, rules).select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return one_or_none.where("row IS NOT NULL").select("row.*")
