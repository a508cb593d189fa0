"""Toxic passages as maximum-scoring segments of token log-odds.

Training: token counts of distinct toxic and other texts, compared with an informative
Dirichlet prior (the token's share in the whole sample). A token whose log-odds stand out by ``MIN_Z``
standard errors carries them as its score; a word that is not listed falls back on its first ``STEM``
letters, which count as a token of their own; any other token costs ``DRIFT``, so that chance segments
stay short. Scoring:
one linear pass finds every maximal-scoring segment of a text. The scores of the best segments of long
random texts follow an extreme-value law (Karlin and Altschul); its two parameters are taken from the
non-toxic documents, each segment is measured on it, and a logistic curve turns the evidence of the
significant segments into a probability.

The model is fitted on at most ``MAX_LABELLED`` labelled documents (smallest hash first) and holds at most
``MAX_TOKENS`` tokens, so what is sent to the tasks has a fixed bound. Scoring reads whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speciframe.session import cut_lineage

from .common import carried, in_small_batches

MAX_LABELLED = 20_000
MAX_TOKENS = 20_000
MIN_Z = 4.0
MIN_ODDS = 1.0  # common words that lean a little either way are no evidence
PRIOR = 0.1  # weight of the prior against that of the sample
STEM = 4
MIN_TEXTS = 3  # a token that a single text repeats says nothing about others
DRIFT = -0.1
SIGNIFICANT = 0.05  # expected number of such segments in a clean text of that length
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\`~"
_TYPE = "struct<score:double,best:double,segments:array<struct<first:int,last:int,score:double>>>"
_ARROW = pa.struct([
    ("score", pa.float64()), ("best", pa.float64()),
    ("segments", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))),
])


def tokens_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their edges; one token for each word, maybe empty."""
    return [w.strip(_EDGES) for w in text.lower().split()] if text else []


def stem_of(token: str) -> str:
    """The first letters of a longer word, marked so that no word equals them."""
    return f"{token[:STEM]}*" if len(token) > STEM else ""


def maximal_segments(scores: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of (position, score) pairs in order, in linear time.

    Keeps a list of candidates with the cumulative sums before and after each, and with each the place of
    the last candidate before it that starts lower, so that a search passes over any candidate once. A new
    positive score joins the latest candidate that starts lower, when that one also ends lower; otherwise it
    stands alone.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, last one that starts lower
    total = 0.0
    for at, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        first, low = at, before
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, at, low, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in kept]


@dataclass
class Model:
    weights: dict[str, float]
    rate: float = 1.0  # lambda of the extreme-value law
    size: float = 1.0  # its K
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def __post_init__(self):
        self.stems = {w[:-1] for w in self.weights if w.endswith("*")}

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the segments. Runs of unscored tokens are one step of the pass."""
        tokens = tokens_of(text)
        weight = self.weights
        steps: list[tuple[int, float]] = []
        last = -1
        stems = self.stems
        for i in [i for i, t in enumerate(tokens) if t in weight or t[:STEM] in stems]:
            value = weight.get(tokens[i])
            if value is None:
                value = weight.get(stem_of(tokens[i]))
            if value is None:  # a short word that starts a listed stem
                continue
            if i - last > 1:
                steps.append((last + 1, DRIFT * (i - last - 1)))
            steps.append((i, value))
            last = i
        return len(tokens), maximal_segments(steps)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Evidence of the best segment, of all significant ones together, and those segments.

        A segment's evidence is -log of the number of equally good ones expected by chance in n tokens."""
        floor = math.log(max(n, 1) * self.size)
        rated = [(a, b, self.rate * s - floor) for a, b, s in segments]
        chosen = [r for r in rated if r[2] >= -math.log(SIGNIFICANT)]
        best = max((r[2] for r in rated), default=-floor)
        return best, sum(r[2] for r in chosen), chosen

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * _bend(best) + c * _bend(total)))))

    def rate_text(self, text: str | None) -> dict:
        n, segments = self.segments(text)
        best, total, chosen = self.evidence(n, segments)
        return {"score": self.probability(best, total), "best": best,
                "segments": [{"first": a, "last": b, "score": s} for a, b, s in chosen]}


def _bend(x: float) -> float:
    """Evidence on a scale on which a logistic curve is steady at both ends."""
    return math.copysign(math.log1p(abs(x)), x)


def sample(docs: DataFrame, labels: DataFrame, allowed: Callable[[Column], Column]) -> DataFrame:
    """Texts of at most ``MAX_LABELLED`` labelled documents that ``allowed`` lets in, as distinct (text, toxic)."""
    picked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_labelled"), "_labelled").limit(MAX_LABELLED)
    )
    # at most MAX_LABELLED pairs of numbers: a bounded broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_labelled")).groupBy("text").agg(F.max("toxic").alias("toxic"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts = (Counter(), Counter(), Counter())  # in other texts, in toxic texts, texts
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = Counter(tokens_of(text))
            for token, n in list(own.items()):
                own[stem_of(token)] += n
            counts[1 if toxic else 0].update(own)
            counts[2].update(own.keys())
        if len(counts[2]) > 500_000:
            yield _counted(counts)
            counts = (Counter(), Counter(), Counter())
    yield _counted(counts)


def _counted(counts) -> pa.RecordBatch:
    names = list(counts[2])
    columns = [pa.array([c[n] for n in names], pa.int64()) for c in counts]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["token", "other", "toxic", "texts"])


def log_odds(texts: DataFrame) -> DataFrame:
    """(token, texts, delta, z): number of texts, log-odds of toxic against other texts with the Dirichlet prior, and their z-score."""
    counts = (
        texts.mapInArrow(_count, "token string, other bigint, toxic bigint, texts bigint")
        .filter(F.col("token") != "")
        .groupBy("token").agg(F.sum("toxic").alias("y"), F.sum("other").alias("x"), F.sum("texts").alias("texts"))
    )
    totals = counts.agg(F.sum("y"), F.sum("x")).first()
    ny, nx = float(totals[0] or 0), float(totals[1] or 0)
    if not ny or not nx:  # one class alone tells nothing
        return counts.select("token", "texts", F.lit(0.0).alias("delta"), F.lit(0.0).alias("z"))
    prior = (F.col("x") + F.col("y")) * PRIOR
    side = lambda c, n: F.log((c + prior) / (F.lit(n + PRIOR * (nx + ny)) - c - prior))
    delta = side(F.col("y"), ny) - side(F.col("x"), nx)
    error = F.sqrt(1 / (F.col("y") + prior) + 1 / (F.col("x") + prior))
    return counts.select("token", "texts", delta.alias("delta"), (delta / error).alias("z"))


def fit(docs: DataFrame, labels: DataFrame, allowed: Callable[[Column], Column]) -> Model:
    """Without labels of both kinds the model scores every text alike, below 0.5."""
    texts = cut_lineage(sample(in_small_batches(docs), labels, allowed))  # read three times
    top = log_odds(texts).filter((F.abs("z") >= MIN_Z) & (F.abs("delta") >= MIN_ODDS) & (F.col("texts") >= MIN_TEXTS)).orderBy(F.desc(F.abs("z")), "token").limit(MAX_TOKENS).collect()
    model = Model({r["token"]: float(r["delta"]) for r in top})
    if not any(w > 0 for w in model.weights.values()):
        return model

    def measured(told: Callable[[int, list], tuple[float, float]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [told(*model.segments(t)) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).cast(pa.int32()), *[pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1)]], names=["toxic", "a", "b"])

        # at most MAX_LABELLED rows of three numbers
        return texts.mapInArrow(run, "toxic int, a double, b double").collect()

    best_of = measured(lambda n, segments: (float(n), max((s for _, _, s in segments), default=0.0)))
    model.rate, model.size = extreme_value([(r["a"], r["b"]) for r in best_of if not r["toxic"]])
    rows = measured(lambda n, segments: model.evidence(n, segments)[:2])
    x = np.array([(1.0, _bend(r["a"]), _bend(r["b"])) for r in rows])
    model.curve = tuple(_logistic(x, np.array([1.0 if r["toxic"] else 0.0 for r in rows])))
    return model


def extreme_value(clean: list[tuple[int, float]]) -> tuple[float, float]:
    """lambda and K by moments: the best score of n tokens less log(n)/lambda is a Gumbel variable, so its
    spread gives lambda (at least that of scores in nats: 1) and its mean gives K."""
    values = np.array([(max(n, 1), s) for n, s in clean], float)
    if len(values) < 2:
        return 1.0, 1.0
    rate = min(1.0, math.pi / max(values[:, 1].std() * math.sqrt(6), 1e-9))
    size = math.exp(min(50.0, rate * float((values[:, 1] - np.log(values[:, 0]) / rate).mean()) - 0.5772156649))
    return rate, max(size, 1e-9)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton steps for a ridge-penalised logistic curve."""
    w = np.zeros(x.shape[1])
    pull = np.array([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "_toxicity") -> DataFrame:
    """``docs`` with a struct: probability, best evidence, significant segments (first and last token).

    Null or empty texts have no segments and get the probability of no evidence.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(model)

    @F.arrow_udf(_TYPE)
    def rated(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for batch in texts:
            yield pa.array([own.rate_text(t) for t in batch.to_pylist()], _ARROW)

    return in_small_batches(docs).withColumn(into, rated(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, allowed: Callable[[Column], Column]) -> DataFrame:
    """The documents scored below 0.5, with their own columns only, whatever these are called.

    Null and empty texts score as texts without evidence; equal texts stay or go together; an empty table, or
    labels of one kind only, drop nothing.
    """
    model = fit(docs, labels, allowed)
    return score(carried(docs, "text"), model).filter(F.col("_toxicity.score") < 0.5).select("row.*")
