"""Toxicity by weak supervision.

Words and word beginnings that mark toxic documents are drawn from a bounded sample of labelled training rows and dealt
to many lexicon voters; patterns and general insult lists are voters of their own. A generative model of the votes
(given the hidden label, a voter fires with a probability of its own) gets every voter's accuracy, and what correlation
a pair has beyond that, from the moments of the votes over all documents. Its posterior labels train a linear classifier
on the sample, whose inputs are the features found, and that scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, text_rows, written

#: Bounds: labelled training rows, lexicon voters.
SAMPLE, LEXICONS = 20_000, 16
#: Votes at which what a voter's own votes say counts half.
HALF = 20
#: A feature needs this share of toxic documents among those it is in.
PRECISION = 0.8
#: Distinct features that a task counts before it hands them on, and words that a worker remembers.
HELD = 200_000
#: Letters of the beginnings of words that are features.
BEGINNINGS = range(4, 9)
_WORD = re.compile(r"[^\W\d_]+")
#: General insults in four languages, a voter each language.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown fool jerk bastard asshole bitch whore",
    "de": "idiot idioten dummkopf blöd arschloch schlampe hurensohn wichser trottel depp abschaum widerlich missgeburt",
    "fr": "idiot idiote imbécile crétin connard connasse salope pute débile abruti ordure dégueulasse",
    "es": "idiota imbécil estúpido estúpida gilipollas cabrón puta basura asqueroso payaso",
}
_INSULTS = [frozenset(v.split()) for v in INSULTS.values()]
#: Patterns of abuse, a voter each.
PATTERNS = (r"!{3,}", r"\byou(?:'re| are) (?:an? |so )?(?:idiot|stupid|moron|loser|pathetic)", r"\b(?:shut up|go to hell|drop dead|kill yourself)\b", r"[A-Z]{4,}(?: [A-Z]{4,}){3,}")
#: A text that a pattern matches holds one of these, each pattern's in its place.
NEEDS = (("!!!",), ("you're ", "you are "), ("shut up", "go to hell", "drop dead", "kill yourself"), ("",))
_PATTERNS = [re.compile(p) for p in PATTERNS]


def features_of(text: str) -> set[str]:
    """The distinct words of a text, their beginnings of 4 to 8 letters (marked by a star), and those of the beginnings
    that more than one distinct word has (marked by two)."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        seen = Counter(w[:n] for w in words if len(w) > n)
        out.update(x + "*" for x in seen)
        out.update(x + "**" for x, k in seen.items() if k > 1)
    return out


@dataclass(frozen=True)
class Lexicon:
    features: tuple[str, ...]

    def hits(self, text: str) -> list[int]:
        """Places of the features that a text has, then, counted on from there, of the insult lists and patterns that fire."""
        words = set(_WORD.findall(text.lower()))
        at, (plain, starts), silent = self._places()
        found, seen = {at[w] for w in words & plain}, Counter()
        for w in words - silent:
            ours = [x for n, known in starts if len(w) > n and (x := w[:n]) in known]
            seen.update(ours)
            if not ours:
                silent.add(w)
        if len(silent) > HELD:
            silent.clear()
        found.update(at[f] for x, k in seen.items() for f in (x + "*", x + "**")[: 1 + (k > 1)] if f in at)
        base = len(self.features)
        found.update(base + i for i, s in enumerate(_INSULTS) if not s.isdisjoint(words))
        base += len(_INSULTS)
        found.update(base + i for i, (p, needs) in enumerate(zip(_PATTERNS, NEEDS)) if any(n in text for n in needs) and p.search(text))
        return sorted(found)

    def _places(self) -> tuple[dict[str, int], tuple, set[str]]:
        """Places of the features, what to look for, and words met that have no beginning looked for."""
        if "places" not in self.__dict__:
            at = {f: i for i, f in enumerate(self.features)}
            starts = {f.rstrip("*") for f in at if f.endswith("*")}
            by_length = [(n, frozenset(x for x in starts if len(x) == n)) for n in BEGINNINGS]
            object.__setattr__(self, "places", (at, (frozenset(f for f in at if not f.endswith("*")), [x for x in by_length if x[1]]), set()))
        return self.places

    @property
    def width(self) -> int:
        return len(self.features) + len(_INSULTS) + len(_PATTERNS)

    def voters(self, hits: list[list[int]]) -> np.ndarray:
        """Votes (rows by voters, fired or not): features are dealt to the lexicon voters in turn."""
        n, f = min(LEXICONS, len(self.features)), len(self.features)
        votes = np.zeros((len(hits), n + self.width - f), bool)
        for i, h in enumerate(hits):
            for x in h:
                votes[i, x % n if x < f else n + x - f] = True
        return votes


def choose_features(labelled: DataFrame, share: float) -> Lexicon:
    """All features that mark toxic rows of ``labelled`` (text, toxic), each at PRECISION: most toxic rows first. Their
    number is bounded by that of the rows and the test."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def handed() -> pa.RecordBatch:
            keys = list(held[0] | held[1])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[0][k] for k in keys], pa.int64()), pa.array([held[1][k] for k in keys], pa.int64())], names=["feature", "clean", "toxic"])

        for b in batches:
            for t, toxic in zip(b.column(0), b.column(1).to_pylist()):
                held[toxic].update(features_of(t.as_py()))
                if len(held[0]) + len(held[1]) > HELD:
                    yield handed()
                    held = (Counter(), Counter())
        yield handed()

    sums = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = written(sums.where("toxic >= 2"), "features")
    # what a feature's share of toxic rows says against the share of all, in nats, must outweigh how many features are tried
    t, n = F.col("toxic").cast("double"), (F.col("toxic") + F.col("clean")).cast("double")
    says = t * F.log(t / n / F.lit(share)) + F.when(n > t, (n - t) * F.log((n - t) / n / F.lit(1 - share))).otherwise(0.0)
    good = sums.where(t >= PRECISION * n).where(says >= 1 + math.log(max(1, sums.count())))
    # a beginning stands for its words and is preferred where it marks more rows
    top = good.orderBy((F.col("toxic") - 4 * F.col("clean")).desc(), F.length("feature"), "feature").collect()
    return Lexicon(tuple(r.feature for r in top))


@dataclass(frozen=True)
class LabelModel:
    """P(a voter fires | toxic) and | clean, the voters' weights after correlations, and the share of toxic documents."""

    fires: np.ndarray  # 2 by voters: clean, toxic
    weight: np.ndarray
    share: float
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0]) * self.weight
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0])) * self.weight
        z = np.where(votes, on, off).sum(1) + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _median(weighted: list[tuple[float, float]]) -> float:
    """Of (value, weight): where half of the weight lies on either side."""
    v, w = np.array(sorted(weighted)).T
    below = np.cumsum(w) - w / 2
    return float(np.interp(w.sum() / 2, below, v))


def fit_label_model(n: int, ones: np.ndarray, pairs: np.ndarray, share: float) -> LabelModel:
    """From the moments of ``n`` documents' votes: how often each voter fires, and each pair together.

    With hidden label variance s = share (1 - share), the covariance of two voters independent given the label is
    s a_i a_j, a_i being by how much likelier voter i fires on toxic documents. Each a_i is the median over pairs (j, k)
    of sqrt(C_ij C_ik / C_jk / s); what a pair's covariance has beyond that is its correlation. Correlated voters share
    their weight. What a voter says is shrunk by how seldom it fires, and counts less in the others' medians.
    """
    m, s = len(ones), share * (1 - share)
    mean = ones / max(n, 1)
    cov = pairs / max(n, 1) - np.outer(mean, mean)
    alive, sure = ones > 0, ones / (ones + HALF)
    a = np.zeros(m)
    for i in np.flatnonzero(alive):
        others = [j for j in np.flatnonzero(alive) if j != i and cov[i, j] > 0]
        trips = [(cov[i, j] * cov[i, k] / cov[j, k] / s, sure[j] * sure[k]) for x, j in enumerate(others) for k in others[:x] if cov[j, k] > 1e-12]
        a[i] = np.sqrt(_median(trips)) if trips else 0
    high = np.clip(mean + (1 - share) * a * sure, 1e-4, 0.999)
    low = np.clip(mean - share * a * sure, 1e-4, 0.999)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    extra = (cov - s * np.outer(a, a)) / np.outer(spread, spread)
    np.fill_diagonal(extra, 0)
    correlation = np.where(np.outer(alive, alive), np.clip(extra, -1, 1) * np.outer(sure, sure), 0)
    weight = np.where(alive, 1 / (1 + np.maximum(correlation - 0.1, 0).sum(1)), 0)
    return LabelModel(np.stack([np.minimum(low, high), high]), weight, share, correlation)


def fit_classifier(hits: list[list[int]], labels: np.ndarray, width: int, penalty: float = 0.02, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on which features a document has, by Newton's method, each step
    by conjugate gradients. Memory follows the hits of the sample's rows, never a matrix of features."""
    n = len(hits)
    row = np.repeat(np.arange(n), [len(h) + 1 for h in hits])
    col = np.array([x for h in hits for x in (*h, width)], np.int64)
    times = lambda v: np.bincount(row, v[col], n)  # noqa: E731  rows by features
    back = lambda u: np.bincount(col, u[row], width + 1)
    w = np.zeros(width + 1)
    ridge = np.full(width + 1, penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        g, spread = back(labels - p) - ridge * w, p * (1 - p)
        # (X' S X + ridge) step = g, scaled by the diagonal
        scale = 1 / (back(spread) + ridge)
        step, left = np.zeros(width + 1), g.copy()
        z = scale * left
        way, size = z.copy(), left @ z
        enough = 1e-20 * max(size, 1e-300)
        for _ in range(4 * (width + 1)):
            if size <= enough:
                break
            turned = back(spread * times(way)) + ridge * way
            length = size / (way @ turned)
            step += length * way
            left -= length * turned
            z = scale * left
            size, before = left @ z, size
            way = z + size / before * way
        w = w + step
    return w


def _hits(lexicon: Lexicon, text: str) -> Column:
    """The features found in a text column (null: empty): all that later steps need of it."""

    @F.pandas_udf("array<int>")
    def tag(s: pd.Series) -> pd.Series:
        return pd.Series([lexicon.hits(t or "") for t in s])

    return tag(F.col(text))


@dataclass(frozen=True)
class Toxicity:
    lexicon: Lexicon
    model: LabelModel | None
    weights: np.ndarray | None

    def scores(self, hits: list[list[int]]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(hits))
        z = np.array([self.weights[h].sum() for h in hits]) + self.weights[-1] if hits else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample_of(docs: DataFrame, labels: DataFrame, out, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` labelled rows that aren't held out, in the order of a hash of the id.

    Null labels don't count; an id labelled twice is toxic if one label says so; of rows that repeat an id, the one of the
    smallest text hash stands for all.
    """
    l = labels.where("doc_id is not null and toxic is not null").where(~out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    steps = 1 << 62  # fine enough for any number of labels
    share = min(1.0, 0.97 * most / max(1, l.count()))  # thinned where the rows are, so that few go on to the exact limit
    thin = l.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < int(share * steps)) if share < 1 else l
    l = thin.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = docs.join(F.broadcast(l), "doc_id")  # at most ``most`` narrow rows
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic"))
    return one.groupBy("doc_id").agg(first.alias("r")).select("doc_id", "r.text", "r.toxic")


def learn(docs: DataFrame, labels: DataFrame, fold: int, rest: int, id_col: str, text_col: str, keep: list[str], hits: str) -> tuple[Toxicity, DataFrame]:
    """A scorer, and a written table of the columns ``keep`` of all rows with their hits in the column ``hits``. Each text
    is read for its features once. Without toxic and clean labelled rows the scorer gives 0 to everything."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    sample = written(sample_of(text_rows(docs, id_col, text_col), labels, held_out("doc_id", fold, rest)), "labelled")
    toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < toxic < n:
        none = F.array().cast("array<int>")
        return Toxicity(Lexicon(()), None, None), docs.select(*(F.col(f"`{c}`") for c in keep), none.alias(hits))
    lexicon = choose_features(sample, toxic / n)
    tagged = written(docs.select(*(F.col(f"`{c}`") for c in keep), _hits(lexicon, f"`{text_col}`").alias(hits)), "hits")
    m = min(LEXICONS, len(lexicon.features)) + lexicon.width - len(lexicon.features)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pairs = 0, np.zeros((m, m), np.int64)
        for b in batches:
            v = lexicon.voters(b.column(0).to_pylist()).astype(np.float32)
            n += len(v)
            pairs += (v.T @ v).astype(np.int64)
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i]), pa.array(np.r_[-1, j]), pa.array(np.r_[n, pairs[i, j]])], names=["i", "j", "n"])

    sums = tagged.select(hits).mapInArrow(moments, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # a row a pair of voters
    n_docs, pairs = 0, np.zeros((m, m))
    for r in sums:
        if r.i < 0:
            n_docs = r.n
        else:
            pairs[r.i, r.j] = r.n
    model = fit_label_model(n_docs, np.diag(pairs).copy(), pairs, toxic / n)
    rows = [list(r.hits) for r in sorted(sample.select("doc_id", _hits(lexicon, "text").alias("hits")).collect(), key=lambda r: r.doc_id)]  # bounded by SAMPLE
    weights = fit_classifier(rows, model.posterior(lexicon.voters(rows)), lexicon.width)
    return Toxicity(lexicon, model, weights), tagged


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int = 3, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Null texts are empty and score as such; null ids are never labelled;
    very long texts are read whole; repeated rows stay; a score of just ``threshold`` is toxic; without labels of both kinds
    every score is 0; an empty table gives no rows; other columns aren't read."""
    model, tagged = learn(docs, labels, fold, rest, id_col, text_col, [id_col], "hits" if id_col.lower() != "hits" else "_hits")
    scored = tagged.toDF("doc_id", "hits").select(F.col("doc_id").cast("long").alias("doc_id"), _score(model, "hits").alias("score"))
    return scored.select("doc_id", held_out("doc_id", fold, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _score(model: Toxicity, hits: str) -> Column:
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores([list(h) for h in s]), dtype=float)

    return score(F.col(hits))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int = 3, rest: int = 1) -> DataFrame:
    """The rows of ``docs`` (all columns) that score below ``threshold``, a score of just that being toxic. Null texts score
    as empty ones; very long ones are read whole; repeated rows go or stay together; without labels of both kinds all rows
    stay; an empty table gives no rows. Rows wait with their hits in a written table, so no text is read twice."""
    hits = fresh(docs, "hits")
    model, tagged = learn(docs, labels, fold, rest, "doc_id", "text", docs.columns, hits)
    return tagged.where(_score(model, hits) < threshold).drop(hits)
