"""Quality rules, the rule ensemble, toxic segments and mixing."""

import itertools
import math
import pickle
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, quality_rules, rule_classifier, toxic_segments
from corpusloom.llm.labels import without_copies
from corpusloom.llm.stats import FIELDS, measure

ODD = [(1, None, "en", "a"), (2, "", "en", None), (None, "x y", None, None), (4, "a b c " * 40, "en", "a"), (4, "a b c " * 40, "en", "a"), (5, "w" * 200_000, "en", "a"), (6, " \n\t", "", "a")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("quality_stats", F.lit(1))


def plain(text):
    ws = text.encode().split()
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(ws), sum(len(w.decode()) for w in ws), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("text", ["", "a", "a b c a b c", "x x x x x", "é|ü <b>\n\n é|ü <b>\nq", "one two three\none two three\r\n", "a b c d"])
def test_statistics_like_plain_python(text):
    assert measure(text)[:5] == plain(text)


def test_quality_rules_on_odd_rows(spark):
    got = quality_rules.quality_rules(odd(spark)).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got) and all(r.base_failed for r in got)
    assert quality_rules.quality_rules(odd(spark).limit(0)).count() == 0


def test_outliers_fall_outside_adaptive_fences(spark):
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(80)), "en", "s") for i in range(60)]
    noisy = [(99, " ".join(f"w{k}****" for k in range(80)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(clean + noisy, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(99) and all(got.values())
    # where every document is like that, the thresholds are too
    got = quality_rules.quality_rules(spark.createDataFrame([(i, t, "en", "n") for i, t in enumerate([noisy[0][1] + f" z{j}" for j in range(40)])], "doc_id long, text string, lang string, source string"))
    assert got.where("kept").count() == 40


def accuracy(df, labels, name):
    got = df.join(labels, "doc_id").where("held_out").toPandas()
    return (got.predicted == got[name]).mean(), max(got[name].mean(), 1 - got[name].mean())


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    right, base = accuracy(rule_classifier.op5_quality_classifier(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert right > 0.95 > base


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    right, base = accuracy(toxic_segments.op7_toxicity(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert right > base + 0.03


def test_compiled_rules_are_the_model(spark):
    rng = np.random.default_rng(0)
    stats = {f: rng.integers(1, 200, 500) for f in FIELDS}
    model = rule_classifier.fit(stats, (stats["n_symbols"] > stats["word_chars"] * 0.5).astype(float))
    df = spark.createDataFrame([tuple(int(stats[f][i]) for f in FIELDS) for i in range(500)], ", ".join(f"{f} long" for f in FIELDS)).select(F.struct(*FIELDS).alias("s"))
    got = [r[0] for r in df.select(model.score(F.col("s"))).collect()]
    want = model.predict(rule_classifier.feature_arrays(stats), 500)
    assert model.weights and np.allclose(got, want)
    model.weights *= 8
    scored = model.add_score(df.withColumn("rule_features", F.lit(1)), F.col("s"), "q")
    assert scored.columns == ["s", "rule_features", "q"]
    many = model.predict(rule_classifier.feature_arrays(stats), 500)
    assert np.allclose([r.q for r in scored.collect()], many) and scored.where("q >= 0.7").count() == (many >= 0.7).sum()
    model.weights = []
    assert {round(r.q, 9) for r in model.add_score(df, F.col("s"), "q").collect()} == {round(1 / (1 + math.exp(-model.intercept)), 9)}


def test_classifiers_without_labels_and_on_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd(spark)
    q = rule_classifier.score_documents(docs, rule_classifier.train(docs, none), "q")
    assert {r.q for r in q.collect()} == {0.5} and q.count() == len(ODD)
    t = toxic_segments.score_documents(docs, toxic_segments.train(docs, none), "t").collect()
    assert len(t) == len(ODD) and all(abs(r.t.score - 0.5) < 1e-9 for r in t)


def brute_segments(s):
    """Ruzzo and Tompa's definition: the best segment, then the same on either side of it."""
    if not len(s):
        return []
    sums = np.r_[0, np.cumsum(s)]
    best = max(((sums[b] - sums[a], -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    a, b = best[3], best[4]
    return brute_segments(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_maximal_segments_like_brute_force():
    rng = np.random.default_rng(2)
    for k in range(300):
        scores = rng.normal(-0.2, 1, 25) if k % 2 else np.where(rng.random(25) < 0.4, rng.random(25) * 3, -0.37)
        got = toxic_segments.maximal_segments(scores)
        want = sorted(brute_segments(scores))
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    assert toxic_segments.maximal_segments(np.full(5, -1.0)) == [] == toxic_segments.maximal_segments(np.zeros(0))
    assert toxic_segments.maximal_segments(np.ones(5)) == [(0, 5, 5.0)]


@pytest.mark.parametrize("shape", ["falling", "level", "rising"])
def test_segments_take_linear_time(shape):
    n = 16_000
    scores = np.full(2 * n, -1.0)
    scores[::2] = {"falling": np.linspace(0.9, 0.1, n), "level": 0.5, "rising": np.linspace(0.1, 0.99, n)}[shape]
    began = time.process_time()
    assert toxic_segments.maximal_segments(scores)
    assert time.process_time() - began < 0.2


def test_every_token_has_log_odds_of_its_own_or_of_a_stem_s(spark):
    """Documents of words and stems, Dirichlet priors, deviations, and what a document's own tokens change, against plain counting."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    apart = lambda k, ws: " ".join(f"{w} own{k}x{i}" for i, w in enumerate(ws.split()))  # noqa: E731  no two texts share five words
    rows = [(i, apart(k, "badword fine " + "day " * (k % 3)) if k % 4 == 0 else apart(k, "fine day good today badge") if k % 3 else f"day k{k}", int(k % 4 == 0)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxic_segments.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    counts, tokens = {}, {}
    kinds = lambda w: [*((n, w[:n]) for n in (4, 5, 6) if len(w) >= n), (0, w)]
    for _, t, y in rows:
        for into, found in ((counts, {f for w in t.split() for f in kinds(w)}), (tokens, [f for w in t.split() for f in kinds(w)])):
            for f in found:
                c = into.setdefault(f, [0, 0])
                c[0] += y
                c[1] += 1
    share = sum(len(t.split()) for _, t, y in rows if y) / sum(len(t.split()) for _, t, _ in rows)
    assert math.isclose(model.share, share)
    n_toxic = sum(y for _, _, y in rows)
    assert (model.n_toxic, model.n_all) == (n_toxic, len(rows))

    def odds(f, dt, dn):
        t, n = counts.get(f, (0, 0))
        t, n = max(t - dt, 0), max(n - dn, 0)
        if not n:
            return 0.0, 0.0
        t = min(t, n)
        prior = toxic_segments.PRIOR * n / len(rows)
        one = lambda k, m: math.log((k + prior) / (m - k + toxic_segments.PRIOR - prior + 0.5))
        delta = one(t, n_toxic - dt) - one(n - t, len(rows) - n_toxic - dn + dt)
        z = abs(delta) / math.sqrt(1 / (t + prior) + 1 / (n - t + prior))
        k, m = tokens[f]
        q = (k + toxic_segments.PRIOR * share) / (m + toxic_segments.PRIOR)
        return z, (math.log(q / (1 - q)) - math.log(share / (1 - share))) * min(z / toxic_segments.SURE, 1) ** toxic_segments.POWER

    for dt, dn in ((0, 0), (0, 1), (1, 1)):
        scores = model.scores(dt, dn)
        for w in ("badword", "badwords", "badge", "fine", "day", "unseen", "good"):
            z, want = max((odds(f, dt, dn) for f in kinds(w)), key=lambda x: x[0])
            assert math.isclose(scores[w.encode()] + model.shift, want, abs_tol=1e-5), (w, dt, dn)
    again = pickle.loads(pickle.dumps(model))  # only held slots travel
    assert all(np.array_equal(getattr(again, n), getattr(model, n)) for n in toxic_segments.COUNTS_OF) and again.share == model.share
    whole = model.scores()
    assert whole[b"badword"] > 0 > whole[b"good"]


def test_copies_of_a_text_count_once(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 80))
    base = [text() for _ in range(30)]
    rows = [(i, 0, t) for i, t in enumerate(base)] + [(100 + i, 1, base[3]) for i in range(20)] + [(200 + i, 1, base[4] + f" end{i}") for i in range(20)] + [(300, 0, None), (301, 1, ""), (302, 0, None)]
    got = {r.doc_id for r in without_copies(spark.createDataFrame(rows, "doc_id long, y int, text string").repartition(3)).collect()}
    assert got == {*range(30), 300, 301, 302}


def test_law_of_the_best_segment_holds_for_clean_text():
    """Under a score distribution of known lambda, p-values of random texts are about uniform."""
    rng = np.random.default_rng(5)
    model = toxic_segments.ToxicModel(*[np.zeros(0)] * 4)
    model.rate, model.size = math.log(0.7 / 0.3), 1.0  # +1 with probability 0.3, else -1: E[exp(lambda s)] = 1
    best = lambda: max((s for _, _, s in toxic_segments.maximal_segments(np.where(rng.random(400) < 0.3, 1.0, -1.0))), default=0.0)
    x = np.array([model.standard(400, best()) for _ in range(600)])
    model.size = 1 / np.exp(-x).mean()
    p = -np.expm1(-np.exp(-np.array([model.standard(400, best()) for _ in range(600)])))
    assert 0.02 < (p <= 0.05).mean() < 0.1 and 0.35 < (p <= 0.5).mean() < 0.65


def test_raking_meets_marginals_like_plain_numpy(spark):
    rng = np.random.default_rng(3)
    cells = [(f"s{a}" if a else None, f"l{b}", c, int(rng.integers(1, 1000))) for a, b, c in itertools.product(range(4), range(3), range(2))]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    goals = {d: mixing.targets(df, d) for d in mixing.DIMS}
    x = np.array([c[3] for c in cells], float).reshape(4, 3, 2)
    want = x.copy()
    for _ in range(200):
        for axis in range(3):
            other = tuple(i for i in range(3) if i != axis)
            m = x.sum(other) ** mixing.FLATTEN
            shape = [1, 1, 1]
            shape[axis] = -1
            want *= ((m / m.sum()) / want.sum(other)).reshape(shape)
    for local, tolerance in ((1 << 17, 1e-8), (0, 1e-4)):  # in the driver's memory, and as tables
        raked, error = mixing.rake(df, goals, tolerance, 60, local)
        got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
        assert error <= tolerance
        assert np.allclose([got[(a, b, c)] for a, b, c, _ in cells], want.ravel(), rtol=1e-3 if not local else 1e-5)


def test_probabilities_are_the_same_in_memory_and_in_tables(spark):
    rng = np.random.default_rng(6)
    cells = [(f"s{a}", f"l{b}" if b else None, c, int(rng.integers(1, 1000))) for a, b, c in itertools.product(range(3), range(3), range(3)) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    found = []
    for local in (1 << 17, 0):
        known, error = mixing.calibrated(df, 0.4, local)
        found.append({r[:3]: r.probability for r in known.select("source", "lang", "topic", "probability").collect()})
        assert error < 1e-3 and math.isclose(sum(found[-1][c[:3]] * c[3] for c in cells), 0.4 * sum(c[3] for c in cells), rel_tol=1e-3)
    assert all(math.isclose(found[0][c[:3]], found[1][c[:3]], rel_tol=5e-3) for c in cells)
    assert mixing.calibrated(df.limit(0))[0].count() == 0


def test_raking_says_what_it_could_not_meet(spark):
    df = spark.createDataFrame([("a", "x", 0, 10), ("b", "y", 0, 10)], "source string, lang string, topic int, tokens long")
    goal = lambda d, **v: spark.createDataFrame([(k, x) for k, x in v.items()], f"goal_{d} string, goal double")
    topic = spark.createDataFrame([(0, 1.0)], "goal_topic int, goal double")
    for local in (1 << 17, 0):
        assert mixing.rake(df, {"source": goal("source", a=0.9, b=0.1), "lang": goal("lang", x=0.5, y=0.5), "topic": topic}, 1e-4, 5, local)[1] > 0.5
        assert mixing.rake(df, {"source": goal("source", a=0.5, b=0.5), "lang": goal("lang", x=0.5, y=0.5, z=0.0), "topic": topic}, 1e-4, 5, local)[1] <= 1e-4


def test_topics_are_clusters_of_words(spark):
    rng = np.random.default_rng(4)
    names = [[f"{p}{k}word" for k in range(30)] for p in ("farm", "ship", "star")]
    rows = [(i, " ".join(rng.choice(names[i % 3], 60)) + " and the of", "en", "s") for i in range(150)] + [(200, None, "en", "s"), (201, "a b", "en", "s"), (201, "a b", "en", "s")]
    got = {r.doc_id: r.topic for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    assert got[200] == got[201] == -1
    for a, b in itertools.combinations(range(3), 2):
        assert not {got[i] for i in range(150) if i % 3 == a} & {got[i] for i in range(150) if i % 3 == b}


def test_sample_meets_the_budget_and_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("weight", F.lit("clash"))
    got = mixing.mixed(docs).toPandas()
    assert abs((got.probability * got.n_tokens).sum() / got.n_tokens.sum() - mixing.BUDGET) < 1e-3
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == set(got[got.kept].doc_id)
    assert mixing.mixed(odd(spark)).count() == len(ODD) and mixing.mixed(odd(spark).limit(0)).count() == 0


def test_held_out_is_the_crc(spark):
    got = spark.range(50).select("id", rule_classifier.crc_mod(F.col("id"), 4).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in got)
