"""Top-k search, Jaccard join, components and quotation links against brute force."""

import math
import pickle
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, quote_links, topk_search
from corpusloom.llm import shingles as word_shingles
from corpusloom.llm.components import components


def test_top_k_like_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (8, 12))
    v = (centres[rng.integers(0, 8, 600)] + rng.normal(0, 0.1, (600, 12))).astype(np.float32)
    v[100:160] = v[100]  # one common vector
    rows = [(i, v[i].tolist(), "x") for i in range(600)]
    rows += [(700, None, "x"), (750, [1.0, None], "x"), (800, [float("nan")] * 12, "x"), (850, [], "x"), (None, v[0].tolist(), "x"), (900, [1.0] * 5, "x"), (0, v[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    q = topk_search.quantised(df)
    got = {}
    for r in topk_search.top_k(q, q.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    w = np.floor(256 * v.astype(float)).astype(int)
    for i in range(0, 600, 50):
        s = w @ w[i]
        order = [int(j) for j in np.lexsort((np.arange(600), -s)) if j != i][:5]
        assert [got[i][k] for k in range(1, 6)] == [(j, int(s[j])) for j in order]
    assert set(got) == set(range(0, 600, 50))
    assert topk_search.top_k(q.limit(0), q.limit(0)).count() == 0


def test_blocks_of_queries_give_what_one_block_gives(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 6).tolist()) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    q = topk_search.quantised(df)
    rows = lambda: sorted(map(tuple, topk_search.top_k(q, q.where("vec_id % 3 = 0"), 5).collect()))
    one = rows()
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 30)
    assert rows() == one and len(one) == 500


def test_repeated_rows_leave_room_for_other_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in [1] * 10 + [2, 3, 4, 5, 6, 7]] + [(50, [1.0, 1.0])] * 10
    q = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in topk_search.top_k(q, q.where("vec_id in (1, 50)"), 5).collect())
    assert got == [(1, k, k + 1) for k in range(1, 6)] + [(50, k, k) for k in range(1, 6)]


def test_top_k_of_long_and_large_vectors(spark):
    """Vectors of 768 components, and of sizes up to the largest double, as queries and as candidates."""
    rng = np.random.default_rng(6)
    unit = rng.normal(0, 1, (60, 768))
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    size = 10.0 ** np.r_[np.zeros(20), rng.uniform(6, 12, 20), rng.uniform(12, 300, 16), 308, 308, 308, 308]
    large = rng.uniform(-1, 1, (60, 3)) * size[:, None]
    large[20:24] = large[20]
    vectors = [*unit, *large, *large[[20, 21, 40]]]
    ids = [*range(120), 80, 81, 100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>").repartition(3)
    q = topk_search.quantised(df)
    got = {}
    for r in topk_search.top_k(q, q.where("vec_id % 5 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    e = {i: [math.floor(256 * Fraction(x)) for x in v.tolist()] for i, v in zip(ids, vectors)}
    assert set(got) == set(range(0, 120, 5))
    for i in got:
        scores = sorted((-sum(a * b for a, b in zip(e[i], e[j])), j) for j in e if j != i and len(e[i]) == len(e[j]))[:5]
        assert [got[i][k] for k in range(1, 6)] == [(j, -s if -(2**63) <= -s < 2**63 else None) for s, j in scores]


def test_pruning_skips_products():
    rng = np.random.default_rng(0)
    c = rng.normal(0, 300, (20, 8))
    v = np.floor(c[np.arange(4000) % 20] + rng.normal(0, 2, (4000, 8))).astype(np.int64)
    ids = np.arange(4000)
    q = ids % 50 == 0
    best = topk_search.Best(int(q.sum()), 5)
    done = topk_search.dual_search(topk_search.CoverTree(v[q], 8), v[q], ids[q], topk_search.CoverTree(v), v, ids, best)
    assert done < 0.5 * q.sum() * 4000


def shingles(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(30):
        base = [word() for _ in range(r.choice([3, 8, 40, 120]))]
        if r.random() < 0.5:
            base += passage
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = [w if r.random() > 0.012 else word() for w in base]
            rows.append((len(rows), " ".join(copy)))
    hub = [word() for _ in range(100)]
    for _ in range(60):  # near copies of one text, many of which only link to it
        copy = list(hub)
        for p in r.sample(range(100), r.choice([0, 1, 2, 3, 4])):
            copy[p] = word()
        rows.append((len(rows), " ".join(copy).title() if r.random() < 0.5 else " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A\tB"), (905, "a b c"), (7, rows[7][1]), (906, "x " * 5000)]


def test_components_like_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [(None, rows[7][1]), (None, rows[7][1] + " more"), (None, "no other text is like this one"), (None, "no other text is like this one"), (None, None), rows[9]]
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int").repartition(3)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()]
        assert sorted(got, key=str) == sorted(brute_components(rows), key=str)


def test_keep_one_of_each_component(spark):
    rows = [*corpus(3), (None, "some text of its own here"), (None, None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n long" if False else "doc_id long, text string, n string")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    named = [x for x in brute_components(rows) if x[0] is not None]
    want = {c for d, n, c in named if n} | {d for d, n, _ in named if not n}
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_bound_never_refuses_a_link(spark):
    """Two sets that link share at least as many prefix shingles as ``enough`` asks for."""
    r = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        both = r.choice(1 << 40, r.integers(3, 80), replace=False).astype(np.uint64) << np.uint64(20)
        more = [np.unique(r.choice(1 << 40, r.integers(0, 12)).astype(np.uint64) << np.uint64(20)) for _ in range(2)]
        a, b = (np.unique(np.concatenate([both, m])) for m in more)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            often = np.sort(r.choice(both, len(both) // 3, replace=False))
            (pa, _, la), (pb, _, lb) = jaccard_join._prefix(a, often), jaccard_join._prefix(b, often)
            rows.append((len(np.intersect1d(pa, pb)), len(a), la, len(b), lb))
    df = spark.createDataFrame(rows, "c long, n long, l long, gn long, gl long")
    c = F.col
    ok = jaccard_join.enough(c("c"), c("n"), c("l"), c("gn"), c("gn"), c("gl"), c("gl"))
    assert len(rows) > 50 and df.where(~ok).count() == 0


def test_groups_are_opened_only_where_their_union_holds_enough(spark, monkeypatch):
    """The matrix's rows are the unions; sets of members meet a unit only in groups that qualify, and no link is lost."""
    r = random.Random(3)
    member = [[f"m{k}x{i}" for i in range(100)] for k in range(4)]
    texts = {k: np.array(sorted(hash(w) % 2**64 for w in m), np.uint64) for k, m in enumerate(member)}
    near = np.array(sorted({*texts[0][:90].tolist(), *range(5)}), np.uint64)
    far = np.array(sorted({*texts[0][:30].tolist(), *range(100, 160)}), np.uint64)
    mixed_ = np.array(sorted({*texts[0][:50].tolist(), *texts[1][:50].tolist()}), np.uint64)  # the union holds it, no member does
    sets = spark.createDataFrame([(k, t.tobytes()) for k, t in {**texts, 10: near, 11: far, 12: mixed_}.items()], "rep long, shingles binary")
    members = spark.createDataFrame([(77, k, k) for k in range(4)], "g long, rep long, cls long")
    asks = spark.createDataFrame([(77, k, k) for k in (10, 11, 12)], "g long, rep long, cls long")
    union = np.frombuffer(jaccard_join.matrix(members, sets).collect()[0].shingles, np.uint64)
    assert np.array_equal(union, np.unique(np.concatenate(list(texts.values()))))
    opened = []
    real = jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda df: opened.append(real(df)) or opened[-1])
    got = jaccard_join.linked(asks, members, sets).collect()
    fit = next(x for x in opened if x.columns == ["g", "rep", "cls"])
    assert {x.rep for x in fit.collect()} == {10, 12} and [(x.u, x.v) for x in got] == [(10, 0)] and r


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (0, 1)]
    r = random.Random(4)
    edges += [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(200)]
    want = {}
    for a, b in edges:
        for x in (a, b):
            want.setdefault(x, x)
    for _ in range(300):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    want = {n: c for n, c in want.items() if any(a != b and n in (a, b) for a, b in edges)}
    for few in (1 << 20, 10):  # in one task, and by steps
        found = components(spark.createDataFrame(edges, "u long, v long").repartition(3), few).collect()
        assert {x.node: x.component for x in found} == want and len(found) == len(want)
        assert components(spark.createDataFrame([], "u long, v long"), few).count() == 0


TALK = [
    (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are  you?\n\nFine.\nAnd you?"), (1, 2, "user", "> > how are you?\n> Fine.\n> And you?\nGood."), (1, 3, "user", "unrelated"),
    (1, 4, "assistant", ">>> How are you?\n>> Fine.\n> Good.\nbye"), (2, 0, "user", "> Good.\nx"), (2, 1, "user", None), (None, 1, "user", "> x"), (3, 0, None, ""), (1, 3, "user", "unrelated"),
]


def test_quotes_link_to_what_was_said(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = quote_links.reply_ordered(df).collect()
    assert len(got) == len(TALK)
    by = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.depth, r.quote_depth, r.body) for r in got}
    assert by[(1, 1)] == (0, 0, 1, 1, "Fine.\nAnd you?") and by[(1, 2)] == (1, 0, 2, 2, "Good.") and by[(1, 4)] == (2, 0, 3, 3, "bye")
    assert by[(1, 3)] == (None, 3, 0, 0, "unrelated") and by[(2, 0)] == (None, 0, 0, 1, "x") and by[(2, 1)][4] == ""
    order = [r.turn for r in got if r.conv_id == 1]
    assert order == [0, 1, 2, 4, 3, 3]
    assert [r.position for r in got if r.conv_id == 1] == list(range(6)) and sorted(r.position for r in got if r.conv_id is None) == [0]
    assert quote_links.reply_ordered(df.limit(0)).count() == 0


def test_quotes_like_sql(spark):
    import duckdb
    import pandas as pd

    from corpusloom.llm.sql import OP2

    rows = TALK + [(5, i, "user", f"said {i}" if not i else f"> said {i - 1}\n>> x\nsaid {i}\n\n> no") for i in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], "Int64"), "turn": [r[1] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    got = quote_links.reply_ordered(df)
    c = duckdb.connect()
    c.register("conversations", conversations)
    want = c.sql(OP2).project(", ".join(got.columns)).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_random_quotes_like_sql(spark):
    """Conversations in which messages quote one another at several levels, in whole, by lines, or wrongly."""
    import duckdb
    import pandas as pd

    from corpusloom.llm.sql import OP2

    r = random.Random(11)
    rows = []
    for conv in range(12):
        said: list[list[str]] = []
        for turn in range(r.randrange(1, 14)):
            lines = []
            for _ in range(r.randrange(0, 3)):
                if said:
                    quoted = r.choice(said)
                    part = quoted if r.random() < 0.5 else [r.choice(quoted)]
                    lines += [">" * (1 if x[0] != ">" else 2) + r.choice(["", " "]) + (x if r.random() < 0.9 else x + " not so") for x in part]
            own = [f"line {conv} {turn} {k} {r.choice(['a', 'B', 'c  d'])}" for k in range(r.randrange(1, 4))]
            said.append(lines + own)
            rows.append((conv, turn, r.choice(["user", "assistant"]), "\n".join(lines + own)))
    got = quote_links.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    c = duckdb.connect()
    c.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = c.sql(OP2).project(", ".join(got.columns)).fetchall()
    found = got.collect()
    assert sum(x.parent_turn is not None for x in found) > 20 and max(x.depth for x in found) > 1
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    place = {(x.conv_id, x.turn): x.position for x in found}
    assert all(place[x.conv_id, x.parent_turn] < x.position for x in found if x.parent_turn is not None)


def test_long_reply_chain(spark):
    rows = [(5, i, "user", f"said {i}" if not i else f"> said {i - 1}\nsaid {i}") for i in range(70)]
    got = {r.turn: (r.thread_turn, r.depth) for r in quote_links.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (0, i) for i in range(70)}


def test_no_python_on_the_path_of_quotes(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    plan = quote_links.reply_ordered(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and math.isfinite(len(plan))


def test_a_large_class_does_not_meet_the_groups_of_units_that_share_too_little(spark):
    """20 lists hold a class of 300 units; 100 others, each a class, are in four of them, and 17 common shingles make a link."""
    rows = [(x, u, 0, 146, 0, 20, u // 64) for x in range(20) for u in range(300)]
    rows += [(x, u, u, 146, 0, 4, 9 + u // 64) for u in range(300, 400) for x in range(u % 16, u % 16 + 4)]
    rows += [(x, 500, 500, 146, 0, 20, 8) for x in range(20)]  # one that may link
    got = jaccard_join.met_groups(spark.createDataFrame(rows, "shingle long, rep long, cls long, n long, last long, s long, g long")).groupBy("rep").count().collect()
    assert {r.rep: r["count"] for r in got} == {500: 20 * 5}


def test_frequent_shingles_are_counted_over_all_documents(spark):
    """Each of 40 passages is in three documents, so none of their shingles may be missed."""
    rows = [(i, f"{' '.join(f'p{i % 40}x{k}' for k in range(7))} own{i}") for i in range(120)] + [(200, "these words are in one text alone"), (None, None)]
    got = set(jaccard_join.frequent_shingles(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).tolist())
    assert got == {s for p in range(40) for s in jaccard_join.shingle_set(" ".join(f"p{p}x{k}" for k in range(7)), jaccard_join.Hashes()).tolist()}


def test_distinct_like_unique():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 50, 3000):
        x = rng.integers(0, 60, n).astype(np.uint64) << np.uint64(58)
        got = word_shingles.distinct(x)
        assert np.array_equal(got, np.unique(x)) and got.dtype == np.uint64


def test_hashes_remember_no_words():
    hashes = word_shingles.Hashes()
    before = len(pickle.dumps(hashes))
    found = word_shingles.shingle_set(" ".join(f"W{i % 1500}" for i in range(3000)), hashes)
    assert len(found) == 1500 and np.array_equal(found, np.unique(found)) and len(pickle.dumps(hashes)) == before
