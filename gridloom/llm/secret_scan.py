"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's expression is turned into a Boolean trigram query. The index holds a
posting (trigram, text key) for every trigram that some rule asks for and every
text that has it; intersecting postings gives each rule its candidates, and only
those meet the rule's expression. Rules without a mandatory trigram scan every text.

The text key is a hash of the row's id and text. Rows whose keys meet share
candidates, which costs a scan and changes no result, as matches decide.

Defined results
    null or empty text      no spans; the digest of an empty list
    repeated rows           each row gets its own result
    null doc_id             scanned like any other row
    ties                    spans with one start are ordered by the order of the rules
    very long text          scanned whole
    empty table             an empty result with the same schema
    clashing column names   input columns live in one struct while spans are worked out
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import stored, whole_row
from gridloom.llm.trigrams import mandatory, trigram_query


@dataclass(frozen=True)
class Rule:
    """`pattern` finds spans; those whose `group` has under `least` characters are dropped. `base` rules always stay."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Letters of the keywords count in either case, by classes and not by a flag, so that only ASCII letters fold.
_KEYWORDS = ("password", "passwd", "secret", "token")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Formats fixed by whoever issues the secrets.
RULES = (
    Rule("assign", "(" + "|".join(map(_either, _KEYWORDS)) + "|" + _either("api") + "_?" + _either("key")
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, base=True),
    Rule("access", "AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", "[0-9a-f]{24,}", least=24, base=True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Of three parts; a first part that no others follow is read as a match without its group and dropped, so no run is read twice.
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}(\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})?", group=1),
    Rule("login_url", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]{3,}@"),
)

#: Spans that are folded together.
BLOCK = 128
#: Keys of candidates, some 100 bytes each, that are sent to every task; more meet their texts by key.
SENT_KEYS = 100_000
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def text_key(row_id: Column, text: Column) -> Column:
    """What postings name a row by."""
    return F.xxhash64(row_id.cast("string"), text)


def vocabulary(rules=RULES) -> list[str]:
    """The trigrams that some rule asks for."""
    return sorted({t for r in rules if mandatory(r.pattern) for way in trigram_query(r.pattern) for t in way})


def postings(df: DataFrame, key: Column, text: Column, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, key), once per row and trigram."""
    listed = F.array(*[F.lit(t) for t in trigrams])
    rows = df.select(key.alias("key"), F.lower(text).alias("t"))
    return rows.select(F.explode(F.filter(listed, lambda g: F.contains(F.col("t"), g))).alias("trigram"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, kinds): the rules of which some alternative has all its trigrams among a key's postings.

    The queries are one row per rule, alternative and trigram, a table fixed by
    the rules, which is broadcast. Each posting sets its trigram's bit; the
    intersection has the key where all bits of an alternative are set. Repeated
    postings change nothing.
    """
    spark = index.sparkSession
    wanted = [(r.kind, at, t, 1 << bit, (1 << len(way)) - 1) for r in rules if mandatory(r.pattern)
              for at, way in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for bit, t in enumerate(way)]
    asked = spark.createDataFrame(wanted, "kind string, way int, trigram string, bit long, all long")
    met = index.join(F.broadcast(asked), "trigram")
    full = met.groupBy("key", "kind", "way").agg(F.bit_or("bit").alias("bits"), F.first("all").alias("all")).where("bits = all")
    return full.groupBy("key").agg(F.collect_set("kind").alias("kinds"))  # at most one entry per rule


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and use it under a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_blocks(items: Column, passed, zero, step) -> Column:
    """A fold over `items` that emits arrays, as the array of all it emits.

    Appending copies what is there, so a single fold would take time with the
    square of the items. Here `passed` gives the part of the state that goes from
    block to block, for the items of one block and the state before it, and each
    block of `BLOCK` items is folded on its own from there. `zero` makes a block's
    first state, `step` takes (state, item); both states have a field `out`.
    """
    def of(listed: Column) -> Column:
        block = lambda b: F.slice(listed, b * BLOCK + 1, F.lit(BLOCK))
        numbers = F.sequence(F.lit(0), F.greatest((F.size(listed) + (BLOCK - 1)).cast("int") / BLOCK, F.lit(1)).cast("int") - 1)
        first = F.array(F.lit(0))
        heads = F.aggregate(numbers, first, lambda acc, b: F.array_append(acc, passed(block(b), F.element_at(acc, -1))))
        return _let(heads, lambda h: F.flatten(F.transform(numbers, lambda b: F.aggregate(
            block(b), zero(F.get(h, b), F.get(h, b + 1)), step, lambda acc: acc["out"]))))

    return _let(items, of)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, leftmost and not overlapping, in code points.

    The parts between the matches and the matches themselves make up the text, so
    their lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    parts, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    checked = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    zipped = _let(found, lambda m: F.transform(F.arrays_zip(F.slice(parts, 1, F.size(m)).alias("p"), m.alias("m"), checked.alias("c")), lambda x: F.struct(
        F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["c"]).alias("checked"))))

    def passed(block: Column, at: Column) -> Column:
        return F.aggregate(block, at, lambda acc, x: acc + x["gap"] + x["size"])

    def zero(at: Column, _: Column) -> Column:
        return F.struct(at.alias("at"), F.expr(f"CAST(array() AS {SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(
            x["checked"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), _in_blocks(zipped, passed, zero, step)).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def scanned(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(row, t, spans): every row as a struct, its text, and its spans by start and order of the rules."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = df.select(whole_row(df).alias("row"), whole.alias("t"), text_key(F.col(f"`{doc_id}`"), whole).alias("key"))
    index = postings(df, text_key(F.col(f"`{doc_id}`"), whole), whole, vocabulary(rules))
    asked = stored(candidates(index, rules), "candidates")
    few = asked.count() <= SENT_KEYS
    marked = base.join(F.broadcast(asked) if few else asked, "key", "left")
    none = F.expr(f"CAST(array() AS {SPAN})")
    columns = []
    for rank, rule in enumerate(rules):
        spans = _spans(F.col("t"), rule, rank)
        if mandatory(rule.pattern):
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none)
        columns.append(spans)
    return marked.select("row", "t", F.array_sort(F.concat(*columns)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]", rules=RULES) -> DataFrame:
    """`df` with every span of its text replaced by `mark`; overlapping spans become one. A null text stays null."""
    spans = scanned(df, doc_id, text, rules)

    def passed(block: Column, at: Column) -> Column:
        return F.aggregate(block, at, lambda acc, s: F.greatest(acc, s["end"]))

    def zero(at: Column, end: Column) -> Column:  # a block's own part of the text is cut out first, so that cuts in it are short
        return F.struct(at.alias("at"), at.alias("head"), F.substring(F.col("t"), at + 1, end - at).alias("part"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(acc["part"], acc["at"] - acc["head"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["head"].alias("head"), acc["part"].alias("part"), out.alias("out"))

    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    clean = F.concat(F.array_join(_in_blocks(F.col("spans"), passed, zero, step), ""), F.substring(F.col("t"), last + 1, F.length("t")))
    names = [F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns]
    return spans.select(*names)
