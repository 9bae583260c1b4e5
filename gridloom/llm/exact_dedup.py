"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions alone.

A text without its white space is cut behind byte patterns of its own, so that a
passage is cut alike wherever it stands. A text's recipe is the ordered list of its
chunks' identifiers. An identifier is a hash that has been verified: all distinct
chunks with one hash are counted, and where two different ones share it, each gets
a number that joins the identifier. Two texts are equal exactly if their recipes are.

Chunk bytes are shuffled once, after equal chunks of a task have been combined;
from then on only recipes travel, 8 bytes for some 400. Groups with more than one
row in `HOT_SHARE` are at most `HOT_SHARE` many, so they are broadcast to their rows;
all others meet their rows by recipe.

Defined results
    null or empty text      equal to each other and to texts of white space alone
    ties                    the row with the most characters stays, then the smallest id, then the first read
    null doc_id             counts as larger than every id; keep_id is null where such a row stays
    repeated rows           one row each in the result, of which one is kept
    very long text          chunks have at most `most` bytes, so no step holds more than its recipe beside it
    empty table             an empty result with the same schema
    clashing column names   input columns live in one struct until the end
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import stored, whole_row

#: A group with more than one row in so many is hot; there can be no more than so many hot groups.
HOT_SHARE = 1000


@dataclass(frozen=True)
class Settings:
    """Chunks have `least` to `most` bytes, but for the last of a text; hashes keep `bits` bits."""

    least: int = 256
    most: int = 4096
    bits: int = 64


def _bytes(modulus: int, rest: int) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(rest, 256, modulus)) + "]"


#: A chunk ends behind three bytes with these remainders, which ordinary prose has once in some 150 bytes.
CUT = f"(?<={_bytes(4, 1)}{_bytes(16, 3)}{_bytes(8, 4)})"


def normalised(text: Column) -> Column:
    """`text` without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks(text: Column, settings: Settings = Settings()) -> Column:
    """The chunks of a normalised text as bytes, in order; together they are its UTF-8 bytes."""
    one_char_a_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    pattern = rf"(?s).{{{settings.least},{settings.most - 1}}}?(?:{CUT}|\z)|.{{1,{settings.most}}}"
    cut = F.regexp_extract_all(one_char_a_byte, F.lit(f"(?:{pattern})"), F.lit(0))
    return F.transform(cut, lambda c: F.encode(c, "ISO-8859-1"))


def hashed(chunk: Column, settings: Settings = Settings()) -> Column:
    digest = F.xxhash64(chunk)
    return digest if settings.bits >= 64 else digest.bitwiseAND((1 << settings.bits) - 1)


def _occurrences(df: DataFrame, text: str, settings: Settings) -> DataFrame:
    cut = df.select(normalised(F.col(f"`{text}`")).alias("t")).select(F.explode(chunks(F.col("t"), settings)).alias("chunk"))
    return cut.select(hashed(F.col("chunk"), settings).alias("key"), "chunk")


def chunk_store(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, chunk): every distinct chunk of all texts once."""
    return _occurrences(df, text, settings).distinct()


def shared_hashes(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame | None:
    """(key, chunk, variant) for the hashes that different chunks share: variant counts them from 1. None if there are none.

    Distinct chunks are counted per hash; only those of a hash with several are looked at again.
    """
    several = stored(
        chunk_store(df, text, settings).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    if several.isEmpty():
        return None
    order = Window.partitionBy("key").orderBy("chunk")
    again = _occurrences(df, text, settings).join(several, "key", "left_semi").distinct()
    return stored(again.withColumn("variant", F.row_number().over(order)), "hashes")


def recipes(df: DataFrame, text: str = "text", keep=None, settings: Settings = Settings()) -> DataFrame:
    """(row, at, n_chars, text_sha256, recipe, variants) for every row of `df`, stored.

    `recipe` lists the hashes of the chunks. `variants` has (place, variant) for
    those that other chunks share, and is empty in practice; both together are the
    ordered list of verified identifiers. `at` numbers the rows.
    """
    shared = shared_hashes(df, text, settings)
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    cut = df.select(whole_row(df, keep).alias("row"), F.length(plain).cast("long").alias("n_chars"), normalised(F.col(f"`{text}`")).alias("t")).select(
        "row", "n_chars", F.sha2("t", 256).alias("text_sha256"), chunks(F.col("t"), settings).alias("chunks"))
    made = cut.withColumn("recipe", F.transform("chunks", lambda c: hashed(c, settings))).withColumn("at", F.monotonically_increasing_id())
    unshared = F.expr("CAST(array() AS array<struct<place:int,variant:int>>)")
    if shared is None:
        return stored(made.drop("chunks").withColumn("variants", unshared), "recipes")
    made = stored(made, "recipes")
    found = made.select("at", F.posexplode("chunks").alias("place", "chunk")).withColumn("key", hashed(F.col("chunk"), settings))
    told = found.join(shared, ["key", "chunk"]).groupBy("at").agg(
        F.array_sort(F.collect_list(F.struct("place", "variant"))).alias("told"))
    return stored(
        made.drop("chunks").join(told, "at", "left").withColumn("variants", F.coalesce("told", unshared)).drop("told"), "recipes")


def equal_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep=None, settings: Settings = Settings()) -> DataFrame:
    """(row, at, text_sha256, keep_id, group_size, kept): every row with the row of its group that stays.

    `keep` limits the columns of `row`; `doc_id` is always among them.
    """
    columns = list(dict.fromkeys([doc_id, *(keep or df.columns)]))
    rows = recipes(df, text, columns, settings)
    own = F.col(f"row.`{doc_id}`")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), own.isNull().alias("no_id"), own.alias("keep_id"), "at"))
    groups = stored(
        rows.groupBy("recipe", "variants").agg(F.count("*").alias("group_size"), best.alias("best")).select(
            "recipe", "variants", "group_size", "best.keep_id", F.col("best.at").alias("first")), "groups")
    total = rows.count()
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > total))  # fewer than HOT_SHARE rows
    by = ["recipe", "variants"]
    in_hot = rows.join(hot, by)
    in_others = rows.join(hot.select(*by), by, "left_anti").join(groups.where(F.col("group_size") * HOT_SHARE <= total), by)
    return in_hot.unionByName(in_others).select(
        "row", "at", "text_sha256", "keep_id", "group_size", (F.col("at") == F.col("first")).alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """`df` with one row of each group of equal texts, in its own columns."""
    kept = equal_texts(df, doc_id, text, settings=settings).where("kept")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def rebuilt(recipe_rows: DataFrame, store: DataFrame) -> DataFrame:
    """(at, t): the normalised texts put together again from their recipes and the chunk store."""
    variants = Window.partitionBy("key").orderBy("chunk")
    size = F.count("*").over(Window.partitionBy("key"))
    named = store.withColumn("variant", F.when(size > 1, F.row_number().over(variants)).otherwise(0))
    listed = recipe_rows.select("at", "variants", F.posexplode_outer("recipe").alias("place", "key"))
    told = F.filter("variants", lambda v: v["place"] == F.col("place"))
    asked = listed.withColumn("variant", F.coalesce(F.try_element_at(told, F.lit(1))["variant"], F.lit(0)))
    parts = asked.join(named, ["key", "variant"], "left").groupBy("at").agg(
        F.array_sort(F.collect_list(F.struct("place", F.decode("chunk", "ISO-8859-1").alias("c")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["c"]), "")
    return parts.select("at", F.decode(F.encode(text, "ISO-8859-1"), "UTF-8").alias("t"))
