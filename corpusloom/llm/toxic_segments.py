"""Toxic passages as maximum-scoring segments of token log-odds.

Every word and stem has the log-odds of its tokens' rates in toxic against other documents, of either sign, under a
Dirichlet prior centred on the background; those that chance explains, by the documents that hold it, count less. A token
has the log-odds of the surest of its word and stems. One linear scan of a text finds all its maximal-scoring segments, and the extreme-value law
of the best segment under clean text turns scores into p-values and, fitted on labelled documents, into a probability.
Labelled documents are scored without their own counts when the law is fitted, so that it holds for others too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_mod, fresh, lower_words, table, tidy, trim
from corpusloom.llm.labels import labelled_sample, without_copies

#: stripped from both ends of a word
EDGES = b".,;:!?\"'()[]{}|*#$%&<>"
#: a word's stems are its first code points, so many
STEMS = (4, 5, 6)
#: weight of the priors, in documents and in tokens
PRIOR = 20.0
#: standard deviations from which on log-odds count in full; below, by this power of the share of it
SURE, POWER = 5.0, 4
#: words and stems are counted by a hash modulo this: 16 MB of counts, whatever the texts
SLOTS = 1 << 20
#: the mean score of a clean token is minus this at most: the law needs a negative one
DRIFT = 0.01
#: standardised maxima from here on have one probability, as copies of one text have any
TOP = 8.0
COUNTS = ("toxic", "n", "toxic_tokens", "tokens")
#: width of the bins in which scores of clean tokens are counted
BIN = 0.01
#: words that a worker remembers scores of
MEMO = 100_000
#: p-value of a significant passage
SIGNIFICANT = 0.01


def slots(word: bytes) -> list[int]:
    """Where the stems of a word, from the shortest, and the word without its edges are counted."""
    bare = word.strip(EDGES)
    if not bare:
        return []
    text = bare.decode("utf-8", "replace")
    out = [xxhash.xxh3_64_intdigest(text[:n].encode("utf-8", "replace"), n) % SLOTS for n in STEMS if len(text) >= n]
    return [*out, xxhash.xxh3_64_intdigest(bare) % SLOTS]


class _Slots(dict):
    """Word to its slots; forgets all when full."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = slots(word)
        return found


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in order, in linear time.

    A segment is maximal if all its proper subsegments score less and no larger one does so. Runs of positive scores
    are taken whole. Each segment keeps the number of the last one before it that begins at a smaller sum, so a search
    for such a one passes none twice.
    """
    positive = scores > 0
    if not positive.any():
        return []
    bounds = np.flatnonzero(np.r_[True, positive[1:] != positive[:-1]])
    sums = np.add.reduceat(scores, bounds).cumsum()
    ends = np.r_[bounds[1:], len(scores)]
    runs = np.arange(0 if positive[0] else 1, len(bounds), 2)
    before = np.where(runs > 0, sums[runs - 1], 0.0)
    start, stop, left, right, link = [], [], [], [], []
    for a, b, l, r in zip(bounds[runs].tolist(), ends[runs].tolist(), before.tolist(), sums[runs].tolist(), strict=True):
        j = len(left) - 1
        while j >= 0 and left[j] >= l:
            j = link[j]
        while j >= 0 and right[j] < r:  # it grows by the segments from j on
            a, l = start[j], left[j]
            for x in (start, stop, left, right):
                del x[j:]
            last = link[j]
            del link[j:]
            j = last
        start.append(a)
        stop.append(b)
        left.append(l)
        right.append(r)
        link.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(start, stop, left, right, strict=True)]


COUNTS_OF = ("toxic", "all", "toxic_tokens", "tokens")


def _dense(n: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.float32)
    out[at] = x
    return out


@dataclass
class ToxicModel:
    """toxic, all: documents by slot, toxic ones and all; toxic_tokens, tokens: their tokens; n_toxic, n_all, share: documents and the share of toxic ones' tokens; shift: taken off each score; rate: lambda; size: K; then the logistic fit of the standardised maximum."""

    toxic: np.ndarray
    all: np.ndarray
    toxic_tokens: np.ndarray
    tokens: np.ndarray
    n_toxic: int = 0
    n_all: int = 0
    share: float = 0.5
    shift: float = 0.0
    rate: float = 1.0
    size: float = 0.1
    slope: float = 1.0
    offset: float = 0.0

    def __getstate__(self) -> dict:
        """Only slots that hold something travel."""
        at = np.flatnonzero(self.all) if self.all is not None else None
        return vars(self) | {n: (None if x is None else (len(x), at, x[at])) for n, x in vars(self).items() if n in COUNTS_OF}

    def __setstate__(self, state: dict) -> None:
        vars(self).update({n: x if n not in COUNTS_OF or x is None else _dense(*x) for n, x in state.items()})

    def log_odds(self, less_toxic: int = 0, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of each slot, as it counts, and how many standard deviations its documents are from the background; if wished without a document that holds it."""
        n = np.maximum(self.all.astype(float) - less, 0)
        t = np.clip(self.toxic.astype(float) - less_toxic, 0, n)
        o, toxic, other = n - t, self.n_toxic - less_toxic, self.n_all - self.n_toxic - (less - less_toxic)
        prior = PRIOR * n / max(self.n_all, 1) + 1e-12
        delta = np.log((t + prior) / (toxic - t + PRIOR - prior + 0.5)) - np.log((o + prior) / (other - o + PRIOR - prior + 0.5))
        z = np.where(n > 0, np.abs(delta) / np.sqrt(1 / (t + prior) + 1 / (o + prior)), 0.0)
        q = (self.toxic_tokens + PRIOR * self.share) / (self.tokens + PRIOR)
        odds = np.log(q / (1 - q)) - math.log(self.share / (1 - self.share))
        return np.where(n > 0, odds * np.minimum(z / SURE, 1) ** POWER, 0.0), z

    def scores(self, less_toxic: int = 0, less: int = 0) -> _Scores:
        return _Scores(*(x.astype(np.float32) for x in self.log_odds(less_toxic, less)), self.shift)

    def standard(self, n: int, best: float) -> float:
        """The Gumbel variable of the best segment of n tokens: log of the inverse of its expected number."""
        return self.rate * best - math.log(self.size * max(n, 1))

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * min(x, TOP) + self.offset, -700), 700)))


class _Scores(dict):
    """Word to its score: the log-odds of its surest slot less the shift; forgets all when full."""

    def __init__(self, odds: np.ndarray, z: np.ndarray, shift: float):
        super().__init__()
        self.odds, self.z, self.shift = odds, z, shift

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        at = slots(word) if len(self.z) else []
        self[word] = s = (float(self.odds[max(at, key=self.z.__getitem__)]) if at else 0.0) - self.shift
        return s

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.float64, len(found))


PASSAGE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())])
RESULT = "score double, x double, p_value double, passages array<struct<start int, stop int, score double, p_value double>>"


def toxicity(text: Column, model: ToxicModel) -> Column:
    """Struct: score (probability that the text is toxic), x (standardised best segment), p_value of the text, passages.

    Passages are all maximal segments, in order, with p_value at most SIGNIFICANT; start and stop count words. Null
    and empty texts have no segments: x is that of score 0.
    """

    held = np.flatnonzero(model.all)
    odds = SparkSession.active().sparkContext.broadcast((len(model.all), held.astype(np.uint32), *(x[held].astype(np.float32) for x in model.log_odds())))
    law = replace(model, toxic=None, all=None, toxic_tokens=None, tokens=None)  # the counts needn't travel

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n, held, *each = odds.value
        model, scores = law, _Scores(*(_dense(n, held, x) for x in each), law.shift)
        tail = lambda x: -math.expm1(-math.exp(min(-x, 700)))
        for batch in batches:
            score, xs, ps, passages = [], [], [], []
            for t in batch:
                words = lower_words(t.as_py())
                found = maximal_segments(scores.of(words))
                x = model.standard(len(words), max((s for _, _, s in found), default=0.0))
                xs.append(x)
                ps.append(tail(x))
                score.append(model.probability(x))
                least = (math.log(model.size * max(len(words), 1)) - math.log(-math.log1p(-SIGNIFICANT))) / model.rate
                each = ((a, b, s, tail(model.standard(len(words), s))) for a, b, s in found if s >= least)
                passages.append([dict(zip(("start", "stop", "score", "p_value"), e, strict=True)) for e in each])
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(xs, pa.float64()), pa.array(ps, pa.float64()), pa.array(passages, pa.list_(PASSAGE))], ["score", "x", "p_value", "passages"])

    return run(text.cast("string"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) to (slot, and of its words: toxic documents, all documents, tokens in toxic ones, all tokens); slot -1 has all tokens."""
    memo = _Slots()
    counts = np.zeros((4, SLOTS + 1), np.int64)
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = lower_words(text.as_py())
            times: Counter = Counter({SLOTS: len(found)})
            for w, k in Counter(found).items():
                for i in memo[w]:
                    times[i] += k
            at, k = np.fromiter(times.keys(), np.int64, len(times)), np.fromiter(times.values(), np.int64, len(times))
            for row, x in ((0, y > 0), (1, 1), (2, k * (y > 0)), (3, k)):
                counts[row, at] += x
    held = np.flatnonzero(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(np.where(held < SLOTS, held, -1)), *(pa.array(c[held]) for c in counts)], ["slot", *COUNTS])


def _best_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression in one variable, by Newton steps with a little ridge."""
    scale = max(float(x.std()), 1e-6)
    m = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    w = np.array([1.0, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        w = w - np.linalg.solve((m.T * (p * (1 - p))) @ m + 1e-3 * np.eye(2), m.T @ (p - y) + 1e-3 * w)
    return max(float(w[0] / scale), 0.0), float(w[1] - w[0] * x.mean() / scale)


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fits on a sample (labels.SAMPLE_ROWS) of labelled rows whose crc32(doc_id as text) mod 3 is not 1, one of near copies.

    Without labels of both kinds every score is the share of toxic labels, 0.5 without any. The counts of the sample, at
    most SLOTS rows, and a number for each of its documents reach the driver.
    """
    sample = without_copies(labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), 3) != 1))
    of = {bool(r.t): r["n"] for r in sample.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    base = (of.get(True, 0) + 0.5) / (sum(of.values()) + 1)
    none = ToxicModel(*[np.zeros(0)] * 4, slope=0.0, offset=math.log(base / (1 - base)))
    if len(of) < 2:
        return none
    counted = sample.select("y", "text").mapInArrow(tidy(_count), "slot long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in COUNTS)).toArrow()
    at = counted["slot"].to_numpy()
    n = [counted[c].to_numpy() for c in COUNTS]
    whole = at == -1
    if not whole.any() or not 0 < n[2][whole][0] < n[3][whole][0]:  # toxic or other documents have no words
        return none
    model = ToxicModel(*(np.zeros(SLOTS, np.float32) for _ in COUNTS), of[True], sum(of.values()), float(n[2][whole][0] / n[3][whole][0]))
    for own, x in zip((model.toxic, model.all, model.toxic_tokens, model.tokens), n, strict=True):
        own[at[~whole]] = x[~whole]
    del counted, at, n, whole
    context = sample.sparkSession.sparkContext
    first = context.broadcast(model)

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, counts = first.value.scores(0, 1), Counter()
        for batch in batches:
            for text in batch.column(0):
                found, n = np.unique(np.round(scores.of(lower_words(text.as_py())) / BIN).astype(np.int64), return_counts=True)
                counts.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bin", "n"])

    bins = sample.where("y <= 0").select("text").mapInArrow(tidy(clean_scores), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    if not bins.num_rows:  # no clean document has a word
        return none
    value, p = bins["bin"].to_numpy() * BIN, bins["n"].to_numpy() / bins["n"].to_numpy().sum()
    model.shift = max(0.0, float(value @ p) + DRIFT)
    value = value - model.shift
    # lambda: the positive root of E[exp(lambda * score)] = 1 under clean text
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * value, 600))).sum() < 1 else (low, mid)
    model.rate, model.size = low, 1.0
    first.destroy()
    second = context.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [second.value.scores(k, 1) for k in (0, 1)]
        for batch in batches:
            rows = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = lower_words(text.as_py())
                top = max((s for _, _, s in maximal_segments(scores[y > 0].of(found))), default=0.0)
                rows.append((y, second.value.standard(len(found), top)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())], ["y", "x"])

    found = sample.select("y", "text").mapInArrow(tidy(best), "y int, x double").toArrow()
    y, x = (found["y"].to_numpy() > 0).astype(float), found["x"].to_numpy()
    # x = rate * best - log(n) so far: the likeliest K is the inverse mean of exp(-x)
    model.size = float(1 / max(np.exp(-x[y == 0]).mean(), 1e-9))
    model.slope, model.offset = _best_fit(np.minimum(x - math.log(model.size), TOP), y)
    second.destroy()
    trim()
    return model


def score_documents(docs: DataFrame, model: ToxicModel, name: str = "toxicity") -> DataFrame:
    """All rows and columns of docs with the struct of ``toxicity`` for the column text.

    Where docs has a column ``name``, in any case of letters, underscores are added. Repeated rows are scored alike, null
    and empty texts as texts without segments; an empty table stays so.
    """
    return docs.withColumn(fresh(docs, name), toxicity(F.col("text"), model))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of their labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.col("toxicity")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), t.score.alias("score"), F.when(t.score >= 0.7, 1).otherwise(0).alias("predicted"), t.p_value.alias("p_value"), F.size(t.passages).alias("n_passages")
    )
