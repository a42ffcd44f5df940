"""Intervals, ledgers, policy and mirrors on literal rows, and against plain Python."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import intervals as I
from corpusloom.operators import ledgers as L
from corpusloom.operators import mirror as M
from corpusloom.operators import policy as P
from corpusloom.operators import structure as S


def plain_union(spans):
    total, end = 0, None
    for a, b in sorted(spans):
        total += max(0, b - (a if end is None else max(a, end)))
        end = b if end is None else max(end, b)
    return total


def plain_peak(spans):
    now = most = 0
    for _, d in sorted([(a, 1) for a, _ in spans] + [(b, -1) for _, b in spans]):
        now += d
        most = max(most, now)
    return most


def test_intervals_like_plain_python(spark):
    r = random.Random(1)
    spans = [(k, i, a := r.randrange(200), a + r.randrange(30), r.randrange(3)) for k in range(4) for i in range(40)]
    df = spark.createDataFrame(spans, "k int, id int, st long, en long, depth int").withColumn("cat", F.col("id") % 3).repartition(3)
    union = {x.k: x.covered for x in I.union_measure(df, ["k"]).collect()}
    peak = {x.k: x.peak for x in I.peak_concurrency(df, ["k"]).collect()}
    alone = {x.k: x.s for x in I.exclusive(df, "k", "cat").groupBy("k").agg(F.sum("exclusive").alias("s")).collect()}
    for k in range(4):
        own = [(a, b) for x, _, a, b, _ in spans if x == k]
        assert (union[k], peak[k], alone[k]) == (plain_union(own), plain_peak(own), plain_union(own))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, id int, st long, en long, depth int, cat string")
    assert not I.union_measure(none, ["k"]).count() and not I.peak_concurrency(none, ["k"]).count() and not I.exclusive(none, "k", "cat").count()


def test_depths_of_chains_cycles_and_orphans(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (7, 99), (8, 9), (9, 8)], "n int, p int")
    got = {r.n: (r.root, r.depth) for r in I.depths(df, "n", "p").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 4), 7: (7, 0), 8: (None, None), 9: (None, None)}


def test_closure_of_a_cycle(spark):
    got = L.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string"))
    assert got.count() == 9


def test_globs(spark):
    rules = spark.createDataFrame([("deep", "src/**/x.py"), ("flat", "src/*.py")], "family string, glob string")
    paths = spark.createDataFrame([("src/a/b/x.py",), ("src/x.py",), ("src/a/y.py",), ("a+b",)], "path string")
    got = {r.path: (r.n, r.family) for r in L.families(paths, rules).collect()}
    assert got == {"src/a/b/x.py": (1, "deep"), "src/x.py": (1, "flat"), "src/a/y.py": (0, None), "a+b": (0, None)}


def test_budget_skips_refused(spark):
    df = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40)], "k int, o int, m int")
    assert {r.o: r.accepted for r in P.budget(df, "k", "o", "m", 100).collect()} == {1: True, 2: False, 3: True}


def test_local_only_refuses_before_keys(spark):
    media = spark.createDataFrame([("audio/wav",)], "media_type string")
    stages = spark.createDataFrame([("transcribe", True, ["audio"], "speech")], "stage string, enabled boolean, applies array<string>, endpoint string")
    ends = spark.createDataFrame([("speech", "hosted", False)], "endpoint string, egress string, key_set boolean")
    assert P.plan(media, stages, ends, local_only=True).first().reason == "local-only"


def test_text_mirror_cases(spark):
    rows = [("a.txt", b"one\rtwo\r\nthree\n"), ("b.txt", b"x\x00y"), ("c.txt", b"caf\xe9"), ("d.txt", b"")]
    got = {r.name: r for r in M.text_mirror(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["a.txt"].body == "# A\n\none\ntwo\nthree\n" and got["a.txt"].byte_size == 15
    assert got["b.txt"].body is None and got["b.txt"].verify == ["binary-content"]
    assert got["c.txt"].verify == ["text-decode-lossy"]
    assert got["d.txt"].body == "# D\n\n\n"


def test_page_map_round_trip(spark):
    pages = spark.createDataFrame([(1, 1, "a😀b"), (1, 2, ""), (1, 3, "c")], "d int, number int, text string")
    m = M.page_map(pages, ["d"], "number", "text").withColumn("body", F.lit("## Page 1\n\na😀b\n\n## Page 2\n\n\n\n## Page 3\n\nc"))
    assert {r.problems for r in M.map_problems(m, ["d"], "number", "body", "text").collect()} == {""}


def test_sheet_golden(spark):
    cells = spark.createDataFrame([("Ledger", r, c, v) for r, c, v in [(1, 1, "Item"), (1, 2, "Amount"), (2, 1, "Opening, balance"), (2, 2, "1500"), (4, 1, "Line\nnote"), (4, 2, "12.5")]], "sheet string, row int, col int, value string")
    got = {r.row: r.line for r in S.sheet_rows(cells, ["sheet"], 2).collect()}
    assert got == {1: "row,Item,Amount", 2: '2,"Opening, balance",1500', 4: '4,"Line\nnote",12.5'}


def test_folds_hold_one_state_and_keep_order(spark):
    from corpusloom.operators import policy, transcript

    rows = [("a", i, 400 if i % 3 else None) for i in range(4000)] + [(None, 1, 5), (None, 2, 1200), ("b", 1, 2000), ("b", 2, 1)]
    df = spark.createDataFrame(rows, "k string, t int, n int").repartition(5)
    got = {(r.k, r.t): r.window for r in transcript.windows(df, "k", "t", "n", 1000).collect()}
    want = {}
    for key in ("a", None, "b"):
        filled, w = 0, 1
        for _, t, n in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            n = n or 0
            if filled and filled + n > 1000:
                filled, w = 0, w + 1
            filled += n
            want[key, t] = w
    assert got == want
    jobs = spark.createDataFrame([("r", 1, 30.0), ("r", 2, 80.0), ("r", 3, None), ("r", 4, 70.0), ("q", 1, 101.0)], "run string, o int, m double")
    assert {(r.run, r.o): r.accepted for r in policy.budget(jobs, "run", "o", "m", 100.0).collect()} == {("r", 1): True, ("r", 2): False, ("r", 3): False, ("r", 4): True, ("q", 1): False}
    assert policy.budget(jobs.limit(0), "run", "o", "m", 1.0).count() == 0


def test_places_with_ties_nulls_and_one_hot_key(spark):
    from corpusloom.functions import order

    rows = [("hot", i % 7, i) for i in range(500)] + [(None, 1, 900), (None, None, 901), ("x", 3, 902), ("x", 3, 902)]
    df = spark.createDataFrame(rows, "k string, a int, i int").repartition(6)
    whole = sorted((r.place, r.k or "", -1 if r.a is None else r.a) for r in order.ranked(df, ["k", "a", "i"]).collect())
    assert [p for p, _, _ in whole] == list(range(1, 505)) and [x[1:] for x in whole] == sorted(x[1:] for x in whole)
    got = {}
    for r in order.ranked_within(df, ["k"], ["a", "i"]).collect():
        got.setdefault(r.k, []).append((r.place, r.i))
    assert sorted(p for p, _ in got["hot"]) == list(range(1, 501)) and [i for _, i in sorted(got[None])] == [901, 900] and [p for p, _ in sorted(got["x"])] == [1, 2]
    links = {r.i: (r.previous_, r.next_) for r in order.linked(spark.createDataFrame([(3,), (1,), (2,)], "i int"), ["i"], "i").collect()}
    assert links == {1: (None, 2), 2: (1, 3), 3: (2, None)}
    assert order.ranked(df.limit(0), ["i"]).count() == 0


def test_passages_are_found_whole_wherever_they_stand(spark):
    from corpusloom.operators import ledgers

    texts = [(1, "a b c d e f g h i"), (2, "xa b c d e f g hx"), (3, "b c d e f g"), (4, None), (5, "short one"), (6, ""), (7, "a b c d e f g h i a b c d e f g h i")]
    passages = [(1, "a b c d e f g h"), (2, "b c d e f g h"), (3, "one"), (4, None), (5, ""), (6, "c d e f g x y z"), (7, "a b c d e f g h")]
    got = {(r.doc, r.item) for r in ledgers.mentions(spark.createDataFrame(texts, "doc int, t string"), spark.createDataFrame(passages, "item int, p string"), "doc", "t", "item", "p").collect()}
    assert got == {(d, i) for d, t in texts for i, p in passages if t is not None and p is not None and p in t}


def test_rules_on_odd_records(spark):
    from corpusloom.operators import reviews

    F = __import__("pyspark.sql.functions", fromlist=["functions"])
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(reviews.ledger_problem(F.lit(""), "t")) is None and one(reviews.ledger_problem(F.lit("\n\n"), "t")) is None
    assert tuple(one(reviews.ledger_problem(F.lit('{"t": "a"}\n{"t": "a"}\n'), "t"))) == (2, "duplicate") and tuple(one(reviews.ledger_problem(F.lit('{"t": "a"}\n[1]\n'), "t"))) == (2, "invalid")
    assert tuple(one(reviews.ledger_problem(F.lit('{"t": "a"}'), "t"))) == (0, "unterminated")
    blocks = one(reviews.log_blocks(F.lit("pre\n## 2024-02-30 x\n## 2024-02-28\n\n## 2024-03-01T10:20 - y\nbody\n\n")))
    assert [(b.header, b.body, str(b.anchor)) for b in blocks] == [("## 2024-02-28", "", "2024-02-28 00:00:00"), ("## 2024-03-01T10:20 - y", "body", "2024-03-01 10:20:00")]
    assert one(reviews.log_blocks(F.lit("nothing"))) == []
    assert not one(reviews.strict_json(F.lit(None).cast("string"))) and one(reviews.strict_json(F.lit('{"a": ["NaN"]}'))) and not one(reviews.strict_json(F.lit('{"a": Infinity}')))
    assert one(reviews.same_boot(F.lit("{ sec = 10, usec = 1 }"), F.lit("{ sec = 15, usec = 2 }"))) and not one(reviews.same_boot(F.lit("{ sec = 10 }"), F.lit("{ sec = 16 }"))) and not one(reviews.same_boot(F.lit(None).cast("string"), F.lit("a")))


def test_exclusive_time_of_spans_within_spans_needs_no_pairs(spark):
    """Each span holds all later ones, so spans and the segments between their ends make a square of pairs."""
    n = 150
    rng = random.Random(5)
    spans = [("t", i, 10 * i, 20 * n - 10 * i, i % 7, f"c{i % 5}") for i in range(n)] + [("t", n + i, (a := rng.randrange(-500, 20 * n)), a + rng.choice([0, 3, 40, 200]), rng.randrange(9), None if i % 9 == 0 else f"c{i % 4}") for i in range(300)]
    spans += [(None, 1, 5, 9, 1, "c0"), ("u", 2, None, 9, 1, "c0"), ("u", 3, 5, None, 1, "c0"), ("u", 4, 9, 5, 1, "c0"), ("u", None, -7, 4, None, "c0"), ("u", 5, -9, 3, None, "c1")]
    df = spark.createDataFrame(spans, "k string, id long, st long, en long, depth long, cat string").repartition(3)
    found = I.exclusive(df, "k", "cat")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    held = {}
    for key, i, a, z, depth, cat in spans:
        if key and a is not None and z is not None:
            for at in range(a, z):
                held.setdefault((key, at), []).append((-1 if depth is None else depth, a - z, -1 if i is None else i, cat))
    want = {}
    for (key, _), over in held.items():
        k = key, max(over, key=lambda x: x[:3])[3]
        want[k] = want.get(k, 0) + 1
    assert {(r.k, r.cat): r.exclusive for r in found.collect()} == want
