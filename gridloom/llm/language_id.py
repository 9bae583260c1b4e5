"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of the character n-grams of its words;
a linear layer on top gives a score per language. Both are trained by stochastic
gradient descent in numpy on a sample of labelled texts of every language, a temperature is
fitted on held-back texts of that sample, and texts whose calibrated score is low
are rejected. Scoring is linear in the n-grams, so a text is a sum over its words,
each of which a task works out once; where there are few languages, embeddings and
layer fold into one row of scores per n-gram.

Defined results
    null text, no letter    `und`, score 0, rejected
    very long text          scored whole; memory grows with one text and one batch of rows
    repeated rows           each row gets its own result
    null label              never used for training
    no labelled row         every text is `und`; `keep_identified` keeps all texts with a letter
    ties between languages  the first in alphabetical order
    empty table             an empty result with the same schema
    clashing column names   `keep_identified` returns the input columns alone
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import whole_row

UNKNOWN = "und"
BUCKETS = 1 << 16
WIDTH = 16
LENGTHS = (2, 3, 4)
#: Labelled texts that training may look at, per language, at most.
SAMPLE_PER_LANGUAGE = 500
#: Labelled texts of all languages that training looks at: where languages are many, each gives fewer, but LEAST_PER_LANGUAGE.
SAMPLE = 100_000
LEAST_PER_LANGUAGE = 20
#: Words that a task remembers at a time.
REMEMBERED = 200_000
#: Calibrated score under which a text is rejected.
LEAST_SCORE = 0.5
#: A letter, in Spark's expressions; numbers such as one half or a Roman eight are none.
LETTER = "\\p{L}"


@dataclass
class Model:
    """Scores per n-gram bucket (one column per language; with `layer`, embeddings that it turns into them), temperature and the languages' names."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    layer: np.ndarray | None = None


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every character n-gram of every word, a mark at either end included."""
    joined = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(joined))
    buckets, owners, mixed = [], [], np.zeros(len(joined), dtype=np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        usable = left >= n
        shifted = np.zeros_like(joined)
        shifted[:len(joined) - n + 1] = joined[n - 1:]
        mixed = (mixed ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in LENGTHS:
            buckets.append((mixed[usable] >> np.uint64(20)) % np.uint64(BUCKETS))
            owners.append(owner[usable])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 3, rate: float = 0.5) -> Model:
    """Fit on (text, language) pairs; every fifth pair is held back for the temperature."""
    languages = sorted({language for _, language in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    rng, number = np.random.default_rng(seed), {language: k for k, language in enumerate(languages)}
    texts = []
    for text, language in rows:
        words = words_of(text)
        if words:
            buckets, counts = np.unique(grams(words)[0], return_counts=True)
            texts.append((buckets, (counts / counts.sum()).astype(np.float32), number[language]))
    held = texts[::5]
    used = [t for at, t in enumerate(texts) if at % 5] or texts
    embedding = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in rng.permutation(len(used)):
            buckets, share, target = used[at]
            hidden = share @ embedding[buckets]
            wrong = _softmax(hidden @ layer + bias)
            wrong[target] -= 1
            back = layer @ wrong
            layer -= step * np.outer(hidden, wrong)
            bias -= step * 0.1 * wrong
            embedding[buckets] -= np.outer(share * (step / share.max()), back)  # the commonest n-gram takes a full step
    hidden = np.array([share @ embedding[buckets] for buckets, share, _ in held]).reshape(len(held), WIDTH)
    temperature = _temperature(hidden, layer, bias, np.array([t for _, _, t in held], dtype=np.int64))
    if len(languages) <= WIDTH:
        return Model(languages, embedding @ layer, bias, temperature)
    return Model(languages, embedding, bias, temperature, layer)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(hidden: np.ndarray, layer: np.ndarray, bias: np.ndarray, targets: np.ndarray) -> float:
    """The one with the smallest loss on held-back texts.

    Targets are a little short of certain, by one text in as many as were held
    back, so that a sample without errors does not ask for boundless certainty.
    """
    if not len(targets):
        return 1.0
    doubt, tried = 1 / (len(targets) + 2), np.geomspace(0.05, 20, 80)
    losses, step = np.zeros(len(tried)), max(1, 2_000_000 // len(bias))
    for at in range(0, len(targets), step):
        logits = hidden[at:at + step] @ layer + bias
        wanted = np.full(logits.shape, doubt / logits.shape[1])
        wanted[np.arange(len(logits)), targets[at:at + step]] += 1 - doubt
        losses += [-(wanted * np.log(_softmax(logits / t) + 1e-12)).sum() for t in tried]
    return float(tried[int(np.argmin(losses))])


class Scorer:
    """Scores texts one after another; remembers what words add up to."""

    def __init__(self, model: Model):
        self.model, self.known, self.sums = model, {}, np.zeros((0, model.table.shape[1] + 1), np.float64)

    def _learn(self, words: set[str]) -> None:
        fresh = sorted(words - self.known.keys())
        if not fresh:
            return
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.sums, fresh = {}, self.sums[:0], sorted(words)
        buckets, owner = grams(fresh)
        sums = np.empty((len(fresh), self.sums.shape[1]))
        for k in range(self.model.table.shape[1]):
            sums[:, k] = np.bincount(owner, self.model.table[buckets, k], len(fresh))
        sums[:, -1] = np.bincount(owner, minlength=len(fresh))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.sums = np.vstack([self.sums, sums])

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, calibrated score) of each text."""
        split = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        self._learn(set().union(*split))
        at = np.fromiter((self.known[w] for words in split for w in words), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        total = np.stack([np.bincount(owner, self.sums[at, k], len(texts)) for k in range(self.sums.shape[1])], axis=1)
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
        logits = (mean if self.model.layer is None else mean @ self.model.layer) + self.model.bias
        sure = _softmax(logits / self.model.temperature)
        best, empty = sure.argmax(axis=1), total[:, -1] == 0
        names = [UNKNOWN if empty[i] else self.model.languages[b] for i, b in enumerate(best)]
        return names, np.where(empty, 0.0, sure[np.arange(len(texts)), best])


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(df: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """Labelled texts for training, about `per_language` of each language at most, chosen by a hash of the row.

    Every language has its share; with more than `SAMPLE` / `per_language` of them, each has less.

    The share of each language follows from its count, so only about as many rows
    as wanted leave the tasks.
    """
    named = df.select(
        F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{language}`").cast("string").alias("l"))
    usable = named.where("t IS NOT NULL AND l IS NOT NULL").where(~held_out(F.col("i")))
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return []
    each = min(per_language, max(LEAST_PER_LANGUAGE, SAMPLE // len(counts)))
    share = F.broadcast(df.sparkSession.createDataFrame([(l, min(1.0, each / n)) for l, n in sorted(counts.items())], "l string, share double"))
    place = F.pmod(F.xxhash64(F.lit(1), F.col("i"), F.col("t")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.join(share, "l").where(place < F.col("share")).select("t", "l").limit(2 * each * len(counts)).collect()
    return sorted((r["t"], r["l"]) for r in chosen)


def identified(df: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """The rows of `df`, their columns (or those in `keep`) in the struct `row`, with lang_pred and score."""
    source = df.select(whole_row(df, keep).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                names, sure = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["row", "lang_pred", "score"])

    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(score, f"row {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language the model is sure of, with their own columns; all with a letter, if it knows no language."""
    if not model.languages:
        return df.where(F.col(f"`{text}`").cast("string").rlike(LETTER))
    return identified(df, model, text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
