"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Voters are lexicon entries (words and word openings that a bounded sample of
labelled texts ties to toxic ones) and patterns over them. The label model takes
the voters and the given labels as noisy votes on a hidden class, and estimates by
expectation maximisation how each voter votes under either class; voters that say much
about each other beyond the class form the pairs of a forest, each a factor of the same
likelihood, so a voter that repeats another adds nothing. A logistic regression then learns the posterior
from the voters' features alone, and scores every text of the corpus.

Defined results
    null or empty text      the score of a text without any feature
    very long text          scored whole
    repeated rows           each row gets its own score; repeated labels of one id count once, as the largest
    null label or id        not used for training
    no toxic label          no voters; every text scores the smoothed share of toxic labels
    ties                    voters of equal evidence are ordered by their text
    empty table             an empty result with the same schema
    clashing column names   input columns live in one struct beside the score
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.language_id import held_out
from gridloom.llm.shared import whole_row

#: Labelled texts that training may look at, at most, of the toxic and of the other class.
SAMPLE_PER_CLASS = 3000
OPENINGS = (4, 5, 6)
MOST_TERMS = 300
LEAST_DOCS = 3
LEAST_EVIDENCE = 3.2
#: Nats a text that two voters have to say about each other, beyond the class, to be modelled as a pair.
LEAST_INFORMATION = 0.01
#: Share of a voter's information that another one has, from which it is a near repeat of it.
NEAR_REPEAT = 0.8
THRESHOLD = 0.7
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESSED = re.compile(r"\b(?:you|your|du|ihr|tu|vous|usted|eres)\b")
_FORMAL = re.compile(r"licen[sc]ed? under|all rights reserved|copyright", re.IGNORECASE)
PATTERNS = ("several", "dense", "addressed", "none", "formal")


def keys_of(word: str) -> list[str]:
    """What a word can be found under: itself and its openings."""
    return [word] + [f"{word[:n]}*" for n in OPENINGS if len(word) > n]


class Voters:
    """Votes of lexicon terms and patterns on texts: 1 toxic, -1 not, 0 none."""

    def __init__(self, terms: list[str]):
        self.terms, self.at, self.known = terms, {t: k for k, t in enumerate(terms)}, {}

    def _hits(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known = {}
            found = self.known[word] = tuple(self.at[k] for k in keys_of(word) if k in self.at)
        return found

    def votes(self, text: str | None) -> dict[int, int]:
        low = text.lower() if text else ""
        words = Counter(_WORD.findall(low))
        hits = {w: h for w in words if (h := self._hits(w))}
        cast = {k: 1 for h in hits.values() for k in h}
        first, total = len(self.terms), sum(words.values())
        if len(hits) >= 2:
            cast[first] = 1
        if hits and sum(words[w] for w in hits) * 100 >= total:
            cast[first + 1] = 1
        if hits and _ADDRESSED.search(low):
            cast[first + 2] = 1
        if not hits and total >= 20:
            cast[first + 3] = -1
        if not hits and text and _FORMAL.search(text):
            cast[first + 4] = -1
        return cast

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        made = np.zeros((len(texts), len(self.terms) + len(PATTERNS)))
        for row, text in enumerate(texts):
            for k, vote in self.votes(text).items():
                made[row, k] = vote
        return made


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    bias: float


def mined_terms(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words and openings whose presence speaks for the toxic class, by log odds, and beyond what chance gives.

    Of all terms that were looked at, less than one should come this far by chance:
    the bound on the chance of so large a toxic share among a term's texts is
    compared with one over the number of terms. Repeated texts count once.
    """
    counts, once = {0: Counter(), 1: Counter()}, {t: int(y) for t, y in zip(texts, toxic)}
    for text, label in once.items():
        counts[label].update({k for w in set(_WORD.findall(text.lower())) for k in keys_of(w)})
    n1 = sum(once.values())
    n0, share, tested = len(once) - n1, n1 / len(once), len(counts[0].keys() | counts[1].keys())
    found = []
    for term, c1 in counts[1].items():
        c0 = counts[0][term]
        seen = c1 / (c1 + c0)
        if c1 < LEAST_DOCS or seen <= share or share in (0, 1):
            continue
        cells = np.array([c1, n1 - c1, c0, n0 - c0]) + 0.5
        odds = np.log(cells[0] * cells[3] / (cells[1] * cells[2]))
        surprise = (c1 + c0) * (seen * np.log(seen / share) + ((1 - seen) * np.log((1 - seen) / (1 - share)) if c0 else 0))
        if odds >= LEAST_EVIDENCE and surprise >= np.log(tested):
            found.append((-odds * c1, term))
    return [term for _, term in sorted(found)[:MOST_TERMS]]


@dataclass
class LabelModel:
    """A hidden class and noisy voters on it; votes are -1, 0 or 1, columns of tables in that order.

    tables[y, v, a] is the chance that voter v votes a under class y. A voter with a
    parent has pairs[y, v, p, a] in its stead: the chance of a where its parent votes p.
    So what two correlated voters say together is a factor of the same likelihood.
    """

    share: float
    tables: np.ndarray
    parents: np.ndarray
    pairs: np.ndarray

    def chances(self, votes: np.ndarray) -> np.ndarray:
        """Posterior chance of class 1 for each row of votes."""
        at, voters = votes.astype(int) + 1, np.arange(votes.shape[1])
        with_parent = self.parents >= 0
        logs = np.log(self.tables[1] / self.tables[0])[voters, at]
        joint = np.log(self.pairs[1] / self.pairs[0])
        logs[:, with_parent] = joint[voters[with_parent], at[:, self.parents[with_parent]], at[:, with_parent]]
        logit = np.log(self.share / (1 - self.share)) + logs.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """How often each voter is right where it votes."""
        right = self.share * self.tables[1, :, 2] + (1 - self.share) * self.tables[0, :, 0]
        voted = self.share * (1 - self.tables[1, :, 1]) + (1 - self.share) * (1 - self.tables[0, :, 1])
        return right / voted


def _fitted(votes: np.ndarray, chance: np.ndarray, parents: np.ndarray) -> LabelModel:
    """The most likely tables for given posteriors, with a little smoothing towards the average vote and the voter's own table."""
    shown = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    classes = np.stack([1 - chance, chance])
    average = shown.mean(axis=0) + 0.01
    tables = np.einsum("yn,nva->yva", classes, shown) + average / average.sum(axis=1, keepdims=True)
    tables /= tables.sum(axis=2, keepdims=True)
    pairs = np.full((2, votes.shape[1], 3, 3), 1 / 3)
    for v in np.flatnonzero(parents >= 0):
        pairs[:, v] = np.einsum("yn,np,na->ypa", classes, shown[:, parents[v]], shown[:, v]) + tables[:, v][:, None, :]
        pairs[:, v] /= pairs[:, v].sum(axis=2, keepdims=True)
    return LabelModel(float(np.clip(chance.mean(), 0.01, 0.99)), tables, parents, pairs)


def _told(votes: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """[v, w]: nats a text that voters v and w say about each other once the class is known; on the diagonal, what v says at all."""
    rows, n = votes.shape
    flat = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float).reshape(rows, 3 * n)
    said = np.zeros((n, n))
    for q in (1 - chance, chance):
        both = ((flat * q[:, None]).T @ flat / max(q.sum(), 1e-9)).reshape(n, 3, n, 3).transpose(0, 2, 1, 3)
        alone = np.einsum("vvaa->va", both)
        expected = alone[:, None, :, None] * alone[None, :, None, :]
        said += q.sum() / rows * np.where(both > 0, both * np.log(np.maximum(both, 1e-12) / np.maximum(expected, 1e-12)), 0).sum(axis=(2, 3))
    return said


def forest(strength: np.ndarray, least: float) -> np.ndarray:
    """The parent of each voter, -1 for none, in the strongest forest of pairs; a pair has to reach `least`.

    Pairs are taken from the strongest on unless they close a circle. The lowest
    voter of each tree is its root.
    """
    n = len(strength)
    group, links = list(range(n)), [[] for _ in range(n)]
    for a, b in sorted(np.argwhere(np.triu(strength, 1) >= least).tolist(), key=lambda ab: (-strength[ab[0], ab[1]], ab)):
        if group[a] != group[b]:
            links[a].append(b)
            links[b].append(a)
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    parents, seen = np.full(n, -1), set()
    for root in range(n):
        queue = [root] if root not in seen else []
        seen.update(queue)
        while queue:
            at = queue.pop()
            for child in links[at]:
                if child not in seen:
                    parents[child] = at
                    seen.add(child)
                    queue.append(child)
    return parents


def label_model(votes: np.ndarray, rounds: int = 15) -> LabelModel:
    """Fit by expectation maximisation from the majority of the votes, in two stages.

    At first only voters that nearly repeat each other are pairs, and count once in
    the majority: on their own they would agree so often that the hidden class became
    theirs. With the class found, pairs are what it leaves unexplained.
    """
    whole = _told(votes, np.zeros(len(votes)))
    least = np.minimum.outer(np.diag(whole), np.diag(whole))
    parents = forest(whole / np.maximum(least, 1e-9), NEAR_REPEAT)
    chance = 0.5 + 0.4 * np.sign(votes[:, parents < 0].sum(axis=1))
    model = _fitted(votes, chance, parents)
    for stage in range(2):
        for _ in range(rounds):
            chance = model.chances(votes)
            model = _fitted(votes, chance, model.parents)
        if stage == 0:
            model = _fitted(votes, chance, forest(_told(votes, chance), LEAST_INFORMATION))
    return model


def posterior(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Chance of the toxic class per text. The given label is one voter among all, and as fallible as its votes turn out to be."""
    every = np.column_stack([labels * 2 - 1, votes])
    return label_model(every).chances(every)


def classifier(votes: np.ndarray, chance: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression of posteriors on votes, by Newton steps with a ridge."""
    x = np.column_stack([votes, np.ones(len(votes))])
    w, cost = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    cost[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - chance) + cost * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(cost), slope)
        w -= step / max(1.0, np.abs(step).max() / 3)
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, toxic) pairs."""
    texts, toxic = [t for t, _ in rows], np.array([y for _, y in rows], dtype=float)
    if not toxic.any():
        return Model([], np.zeros(len(PATTERNS)), float(np.log(0.5 / (len(rows) + 0.5))))
    terms = mined_terms(texts, toxic)
    votes = Voters(terms).matrix(texts)
    weights, bias = classifier(votes, posterior(votes, toxic))
    return Model(terms, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[str, int]]:
    """Labelled texts outside the held-out rows, at most about `per_class` of each class, chosen by a hash of the id.

    The labels are thinned before they meet the documents, so that side of the
    join holds no more rows than the sample and texts are not shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, per_class / n))])
    place = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = known.where(place < share[F.col("toxic")]).limit(2 * per_class * len(counts))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    chosen = texts.join(F.broadcast(few), "doc_id").select("text", "toxic").limit(4 * per_class).collect()
    return sorted((r["text"], r["toxic"]) for r in chosen)


def scored(df: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """The rows of `df`, their columns (or those in `keep`) in the struct `row`, with score and predicted."""
    source = df.select(whole_row(df, keep).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, weights = Voters(model.terms), model.weights.tolist()
        for batch in batches:
            sums = np.array([model.bias + sum(weights[k] * v for k, v in voters.votes(t.as_py()).items()) for t in batch.column(1)])
            chance = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chance, pa.float64()), pa.array((chance >= THRESHOLD).astype(np.int32))], names=["row", "score", "predicted"])

    return source.mapInArrow(score, f"row {source.schema['row'].dataType.simpleString()}, score double, predicted int")
