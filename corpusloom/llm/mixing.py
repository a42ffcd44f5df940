"""Mixing sources to target weights by iterative proportional fitting.

Topics are clusters of the texts' hashed words, weighted by rarity, from Lloyd's steps over all documents. Token weights
of the cells source x language x topic are raked until their marginals meet the targets; a document is then kept with
the probability that its cell's weight needs. A table of cells of checked size is raked in the driver's memory, a larger
one stays a table, by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, fresh, lower_words, settle, table, tidy

#: number of topics, and the share of all tokens that the sample is to have
TOPICS, BUDGET = 8, 0.5
#: target shares are observed shares to this power, normalised
FLATTEN = 0.5
#: largest relative error of a marginal, and rounds at most; the error that remains is returned
TOLERANCE, ROUNDS = 1e-4, 200
#: rows of cells and of goals that are raked in the driver's memory: some 10 MB
LOCAL_CELLS = 1 << 17
DIMS = ("source", "lang", "topic")
#: places that words are hashed to, bytes that such a word has at least, and words that a worker remembers
WIDTH, LEAST_BYTES, MEMO = 256, 4, 100_000
#: Lloyd's steps, and documents among which the first centres are sought
STEPS, SEEDS = 4, 512
#: unit of the sums of vectors: whole numbers, so that the order of additions doesn't matter
UNIT = 1 << 20


class _Places(dict):
    """Word to its place, WIDTH for short words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = at = xxhash.xxh3_64_intdigest(word) % WIDTH if len(word) >= LEAST_BYTES else WIDTH
        return at


def profile(text: str | None, memo: _Places) -> tuple[int, bytes]:
    """Words of a text, and for each place 16 times the logarithm of its words (and one), as a byte."""
    found = lower_words(text)
    n = np.bincount(np.fromiter(map(memo.__getitem__, found), np.int64, len(found)), minlength=WIDTH + 1)[:WIDTH]
    return len(found), np.minimum(np.round(16 * np.log1p(n)), 255).astype(np.uint8).tobytes()


@dataclass
class Topics:
    """Weights of places, the corpus's mean vector, and unit vectors: the centres of the topics."""

    rarity: np.ndarray
    mean: np.ndarray
    centres: np.ndarray

    def vectors(self, profiles: list[bytes]) -> np.ndarray:
        """Unit vectors of what a text has beyond the mean; zero without a word of LEAST_BYTES."""
        x = np.frombuffer(b"".join(profiles), np.uint8).reshape(-1, WIDTH) * self.rarity
        unit = lambda x: x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)
        return np.where(x.any(1, keepdims=True), unit(unit(x) - self.mean), 0.0)

    def of(self, profiles: list[bytes]) -> np.ndarray:
        """The nearest centre of each; -1 without a word of LEAST_BYTES."""
        if not profiles:
            return np.zeros(0, np.int32)
        x = self.vectors(profiles)
        near = (x @ self.centres.T).argmax(1) if len(self.centres) else np.full(len(x), -1)
        return np.where(x.any(1), near, -1).astype(np.int32)


def fit_topics(rows: DataFrame, n: int = TOPICS) -> Topics:
    """Topics of rows (doc_id, profile): first centres apart from one another among SEEDS documents, then Lloyd's steps over all."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH)
            total[:WIDTH] += (x > 0).sum(0)
            total[WIDTH] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["topic", "sums"])

    def total(run, length: int) -> dict[int, np.ndarray]:
        """The sums of all partitions for each topic: TOPICS x WIDTH numbers."""
        parts = rows.select("profile").mapInArrow(run, "topic int, sums array<long>").select("topic", F.posexplode("sums").alias("at", "x"))
        out: dict[int, np.ndarray] = {}
        for r in parts.groupBy("topic", "at").agg(F.sum("x").alias("x")).collect():
            out.setdefault(r.topic, np.zeros(length))[r["at"]] = r.x
        return out

    count = total(held, WIDTH + 1).get(-1, np.zeros(WIDTH + 1))
    model = Topics(np.log((1 + count[WIDTH]) / (1 + count[:WIDTH])) + 0.01, np.zeros(WIDTH), np.zeros((0, WIDTH)))

    def summed(now: Topics):
        """Sums of the vectors by nearest centre, or of all without centres."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((max(len(now.centres), 1), WIDTH), np.int64)
            for batch in batches:
                profiles = batch.column(0).to_pylist()
                if profiles:
                    at, vectors = np.maximum(now.of(profiles), 0), np.round(UNIT * now.vectors(profiles)).astype(np.int64)
                    np.add.at(sums, at, vectors)  # those of texts without longer words are zero
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["topic", "sums"])

        return run

    model.mean = total(summed(model), WIDTH).get(0, np.zeros(WIDTH)) / UNIT / max(count[WIDTH], 1)
    seeds = [bytes(r.profile) for r in rows.select("profile", F.xxhash64("doc_id", "profile").alias("h")).orderBy("h", "profile").limit(SEEDS).collect()]
    x = model.vectors(seeds) if seeds else np.zeros((0, WIDTH))
    x = x[x.any(1)]
    if not len(x):
        return model
    rng = np.random.default_rng(0)
    chosen = [int((x @ x.mean(0)).argmax())]
    far = 1 - x @ x[chosen[0]]
    while len(chosen) < n and far.max() > 1e-9:  # by chance, the more likely the farther: the farthest ones are mere outliers
        chosen.append(int(rng.choice(len(x), p=np.maximum(far, 0) / np.maximum(far, 0).sum())))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    model.centres = x[chosen]
    for _ in range(STEPS):
        got = total(summed(Topics(model.rarity, model.mean, model.centres)), WIDTH)
        model.centres = np.array([got[k] / np.sqrt((got[k] ** 2).sum()) if got.get(k, np.zeros(1)).any() else c for k, c in enumerate(model.centres)])
    return model


# -- raking -------------------------------------------------------------------------------------------------------


def targets(cells: DataFrame, dim: str) -> DataFrame:
    """(goal_<dim>, goal): the share of all tokens that each value is to have."""
    by = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).withColumn("p", F.pow(F.col("t").cast("double"), F.lit(FLATTEN)))
    total = by.agg(F.sum("p")).first()[0] or 1.0
    return by.select(F.col(dim).alias(f"goal_{dim}"), (F.col("p") / total).alias("goal"))


def _rake_here(cells: pa.Table, goals: dict[str, dict], tolerance: float, rounds: int) -> tuple[np.ndarray, float]:
    w = cells["tokens"].to_numpy().astype(float)
    steps = []
    for d in DIMS:
        coded = cells[d].combine_chunks().dictionary_encode(null_encoding="encode")
        steps.append((coded.indices.to_numpy(zero_copy_only=False), np.array([goals[d].get(v, 0.0) for v in coded.dictionary.to_pylist()])))
    for _ in range(rounds):
        worst = 0.0
        for at, goal in steps:
            s = np.bincount(at, w, len(goal))
            by = np.divide(goal, s, out=np.zeros(len(goal)), where=s > 0)
            w = w * by[at]
            worst = max(worst, float(np.abs(by[s > 0] - 1).max(initial=0.0)))
        if worst <= tolerance:
            break
    return w, worst


def _rake_tables(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float, rounds: int) -> tuple[DataFrame, float]:
    """The same steps over tables of any size: each dimension is settled, so plans stay short."""
    now, worst = settle(cells.withColumn("weight", F.col("tokens").cast("double"))), 0.0
    goals = {d: settle(g) for d, g in goals.items()}
    for _ in range(rounds):
        worst = 0.0
        for d in DIMS:
            sums = now.groupBy(F.col(d).alias("v")).agg(F.sum("weight").alias("s")).where("s > 0")
            scale = sums.join(goals[d], F.col("v").eqNullSafe(F.col(f"goal_{d}")), "left").select("v", (F.coalesce("goal", F.lit(0.0)) / F.col("s")).alias("by"))
            scale = settle(scale)
            worst = max(worst, scale.agg(F.max(F.abs(F.col("by") - 1))).first()[0] or 0.0)
            after = settle(now.join(scale, F.col(d).eqNullSafe(F.col("v")), "left").withColumn("weight", F.col("weight") * F.coalesce("by", F.lit(0.0))).drop("v", "by"))
            forget(now)
            forget(scale)
            now = after
        if worst <= tolerance:
            break
    return now, worst


def rake(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS, local: int = LOCAL_CELLS) -> tuple[DataFrame, float]:
    """cells (source, lang, topic, tokens) with ``weight``, shares of all tokens, and the largest relative error of a marginal in the last round.

    goals: for each dimension a table (goal_<dim>, goal) with shares that sum to 1; null values are values like others,
    one without a goal gets weight 0. Goals that only cells without tokens could meet stay unmet, and the error says so.
    """
    if cells.count() + sum(g.count() for g in goals.values()) > local:
        return _rake_tables(cells, goals, tolerance, rounds)
    here = cells.toArrow()
    if not here.num_rows:
        return cells.withColumn("weight", F.lit(0.0)), 0.0
    w, worst = _rake_here(here, {d: {r[f"goal_{d}"]: r.goal for r in g.collect()} for d, g in goals.items()}, tolerance, rounds)
    return cells.sparkSession.createDataFrame(here.append_column("weight", pa.array(w))), worst


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds ``probability``: that of each document of a cell, at most 1, so that the expected tokens are the budget's share.

    The factor common to all cells is found by bisection of its logarithm over sums of the table, a fixed number in one pass.
    """
    ratio = F.col("weight") / F.greatest(F.col("tokens").cast("double"), F.lit(1.0))
    totals = raked.agg(F.sum("tokens").cast("double").alias("n"), F.max(ratio).alias("hi"), F.min(F.when(ratio > 0, ratio)).alias("lo"), F.sum("weight").alias("w")).first()
    if not totals.n or not totals.hi:
        return raked.withColumn("probability", F.lit(0.0))
    # as if no cell were full, and with all full
    low, high = min(budget * totals.n / totals.w, 1.0 / totals.lo), 1.0 / max(totals.lo, 1e-300)
    for _ in range(8):  # 16 points a pass: 16**8 steps
        points = [low * (high / low) ** (i / 16) for i in range(1, 16)]
        at = F.transform(F.array(*(F.lit(p) for p in points)), lambda p: F.col("tokens") * F.least(F.lit(1.0), ratio * p))
        got = {r["i"]: r.s for r in raked.select(F.posexplode(at).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect()}
        under = [p for i, p in enumerate(points) if got[i] <= budget * totals.n]
        over = [p for i, p in enumerate(points) if got[i] > budget * totals.n]
        low, high = max(under, default=low), min(over, default=high)
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * low))


def calibrated(cells: DataFrame, budget: float = BUDGET, local: int = LOCAL_CELLS) -> tuple[DataFrame, float]:
    """cells (source, lang, topic, tokens) with the probability that meets the default targets, and the error that raking left.

    The same steps in the driver's memory where the table is small, without a job for each.
    """
    if cells.count() > local:
        raked, error = rake(cells, {d: targets(cells, d) for d in DIMS}, local=local)
        return probabilities(raked, budget), error
    here = cells.toArrow()
    if not here.num_rows:
        return cells.withColumn("probability", F.lit(0.0)), 0.0
    tokens, goals = here["tokens"].to_numpy().astype(float), {}
    for d in DIMS:
        coded = here[d].combine_chunks().dictionary_encode(null_encoding="encode")
        share = np.bincount(coded.indices.to_numpy(zero_copy_only=False), tokens) ** FLATTEN
        goals[d] = dict(zip(coded.dictionary.to_pylist(), (share / share.sum()).tolist(), strict=True))
    w, error = _rake_here(here, goals, TOLERANCE, ROUNDS)
    ratio = w / tokens
    low, high = budget * tokens.sum() / w.sum(), 1 / max(ratio[ratio > 0].min(), 1e-300)
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if (tokens * np.minimum(1, ratio * mid)).sum() <= budget * tokens.sum() else (low, mid)
    return cells.sparkSession.createDataFrame(here.append_column("probability", pa.array(np.minimum(1.0, ratio * low)))), error


# -- documents ----------------------------------------------------------------------------------------------------


def uniform(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the id, without one from the text."""
    return F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Places()
    for batch in batches:
        found = [profile(t.as_py(), memo) for t in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], ["doc_id", "draw", "source", "lang", "n_tokens", "profile"])


@dataclass
class Mix:
    """topics; cells: (c_source, c_lang, c_topic, probability); rows: one for each document; error: what raking left."""

    topics: Topics
    cells: DataFrame
    rows: DataFrame
    error: float

    def topic(self, profiles: Column) -> Column:
        topics = self.topics

        @F.arrow_udf("int")
        def run(column: pa.Array) -> pa.Array:
            return pa.array(topics.of(column.to_pylist()))

        return run(profiles)

    def topic_of_text(self, text: Column) -> Column:
        topics = self.topics

        @F.arrow_udf("int")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            memo = _Places()
            for batch in batches:
                yield pa.array(topics.of([profile(t.as_py(), memo)[1] for t in batch]))

        return run(text.cast("string"))


def fit_mix(docs: DataFrame, budget: float = BUDGET) -> Mix:
    """Topics, raked cells and probabilities for all rows of docs (doc_id, text, lang, source)."""
    schema = "doc_id long, draw double, source string, lang string, n_tokens long, profile binary"
    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), uniform(F.col("doc_id").cast("long"), text).alias("draw"), F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"))
    profiles = settle(held.mapInArrow(tidy(_profiles), schema))
    mix = Mix(fit_topics(profiles), profiles, profiles, 0.0)
    mix.rows = settle(profiles.select("doc_id", "draw", "source", "lang", mix.topic(F.col("profile")).alias("topic"), "n_tokens"))
    forget(profiles)
    cells = settle(mix.rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    known, mix.error = calibrated(cells, budget)
    mix.cells = settle(known.select(*(F.col(d).alias(f"c_{d}") for d in DIMS), "probability"))
    return mix


def _in_cell(of: DataFrame, topic: str, cells: DataFrame) -> Column:
    return of["source"].cast("string").eqNullSafe(cells["c_source"]) & of["lang"].cast("string").eqNullSafe(cells["c_lang"]) & of[topic].eqNullSafe(cells["c_topic"])


def mixed(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept and raking_error of each row of documents.

    Tokens are words here. Null and empty texts have none and take part in no marginal; their topic is -1, that of texts
    without longer words, and they are kept as these are. Null sources and languages are values; repeated rows are kept
    or left together, and rows without an id by their text; an empty table gives no rows; other columns are ignored.
    raking_error, one for all rows, is the largest relative error of a marginal after raking.
    """
    mix = fit_mix(docs, budget)
    # the table of cells is joined as Spark sees fit: it broadcasts it only below its own threshold
    joined = mix.rows.join(mix.cells, _in_cell(mix.rows, "topic", mix.cells), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return joined.select("doc_id", *DIMS, "n_tokens", "probability", (F.col("draw") < F.col("probability")).alias("kept"), F.lit(mix.error).alias("raking_error"))


def sample(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of docs that ``mixed`` keeps, with all their columns and no others, also where names clash."""
    mix = fit_mix(docs, budget)
    topic = fresh(docs, "mix_topic")
    rows = docs.withColumn(topic, mix.topic_of_text(F.col("text")))
    draw = uniform(rows["doc_id"].cast("long"), rows["text"].cast("string"))
    return rows.join(mix.cells, _in_cell(rows, topic, mix.cells), "left").where(draw < mix.cells["probability"]).select(*(rows[c] for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mixed`` of all documents."""
    return mixed(table(spark, sf_dir, "documents"))
