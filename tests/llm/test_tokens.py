"""Tokens and packing."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import lp_packing, packed_ids
from corpusloom.llm.tokenise import cuts, default_path, encoder

ROWS = [(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "word " * 3000, 0), (4, "Hello, world!\nNew  line <|endoftext|>", 0), (4, "Hello, world!\nNew  line <|endoftext|>", 0), (5, "é" * 5000, 0)]


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, start int")


def ids_of(text):
    t = encoder(default_path()).whole
    return np.array([*(t.encode(text or "", add_special_tokens=False).ids), 2], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t ,.'s19 　€😀"), max_size=40))
def test_ids_are_the_tokenizer_s(text):
    assert np.append(encoder(default_path()).encode(text), np.uint32(2)).tolist() == ids_of(text).tolist()


def test_new_words_take_no_calls_of_their_own(monkeypatch):
    e, calls = encoder(default_path()), []

    class Counted:
        def __getattr__(self, name):
            return lambda text: calls.append(text) or getattr(fast, name)(text)

    at, fast = next((name, x) for name, x in vars(e).items() if type(x).__module__.startswith("tiktoken"))
    monkeypatch.setattr(e, at, Counted())
    text = " ".join(f"neu{i}wort,\nX{i}é" for i in range(2000))
    assert e.document(text).tolist() == ids_of(text).tolist()
    assert len(calls) == 1


@pytest.mark.parametrize("n, want", [(5, [(0, 5)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)])])
def test_cuts(n, want):
    assert cuts(n, 1024) == want


def test_packed_matrix_round_trip(spark):
    parts = Counter()
    rows = packed_ids.packed_matrix(table(spark)).collect()
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        pos = packed_ids.position_ids(r.cu_seqlens)
        assert all(pos[a] == 0 for a in r.position_resets)
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[(d, s, ids[a:b].tobytes())] += 1
    want = Counter()
    for d, t, _ in ROWS:
        ids = ids_of(t)
        want.update((d, a, ids[a : a + n].tobytes()) for a, n in cuts(len(ids), 1024))
    assert parts == want and len({r.sequence_id for r in rows}) == len(rows)
    assert packed_ids.packed_matrix(table(spark).limit(0)).count() == 0


def test_best_fit_decreasing_like_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 33, 60)
        room, want = [], []
        for i in np.argsort(-n, kind="stable"):
            fit = min((r for r in room if r >= n[i]), default=None)
            if fit is None:
                room.append(32 - n[i])
                want.append(1)
            else:
                room[room.index(fit)] -= n[i]
        assert len(packed_ids.best_fit_decreasing(n, 32)) == len(want)


def test_configurations_hold_every_piece():
    rng = np.random.default_rng(2)
    for scale in (1, 40):
        h = {int(k): int(v) * scale for k, v in Counter(rng.integers(1, 1025, 3000).tolist()).items()}
        found, least = lp_packing.configurations(h, 1024)
        got = Counter()
        for p, k in found:
            assert sum(i * j for i, j in p.items()) <= 1024
            for i, j in p.items():
                got[i] += j * k
        total, bins = sum(i * k for i, k in h.items()), sum(k for _, k in found)
        assert got == Counter(h) and bins <= 1.01 * total / 1024 + 2 and least <= bins


def fewest_bins(items, capacity):
    """By trying all ways, longest piece first."""
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            place(k + 1, [r - items[k] if j == i else r for j, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - items[k]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_bound_and_packing_hold_the_optimum_between_them():
    rng = np.random.default_rng(7)
    for _ in range(40):
        items = rng.integers(1, 25, 10).tolist()
        found, least = lp_packing.configurations(Counter(items), 24)
        assert least <= fewest_bins(items, 24) <= sum(k for _, k in found) <= fewest_bins(items, 24) + 1


def test_the_averaged_solution_covers_all_near_the_bound():
    rng = np.random.default_rng(8)
    n = np.zeros(101, np.int64)
    np.add.at(n, rng.integers(20, 90, 4000), 1)
    solution, bound = lp_packing.solve(n, 100)
    cover, value = np.zeros(101), 0.0
    for p, x in solution:
        assert sum(i * k for i, k in p.items()) <= 100
        value += x
        for i, k in p.items():
            cover[i] += k * x
    assert (cover >= n - 1e-6).all() and bound <= value <= 1.15 * bound


def test_patterns_come_from_the_weights_at_every_size():
    import pyarrow.parquet as pq

    for sf in ("sf0.001", "sf0.01"):
        lengths = Counter()
        for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet")["text"].to_pylist():
            lengths.update(k for _, k in cuts(len(encoder(default_path()).document(t)), 1024))
        n = np.zeros(1025, np.int64)
        for i, k in lengths.items():
            n[i] = k
        n[1024] = 0
        pieces = n.sum()
        solution, bound = lp_packing.solve(n, 1024)
        assert lp_packing.rounded(n, solution, bound, 1024) and n.sum() < 0.5 * pieces  # the filler gets less than half


def test_knapsack_like_brute_force():
    value = np.array([0, 1.0, 2.2, 0, 4.1, 0, 0, 7.5])
    got = lp_packing.knapsack(value, 16)
    best = max(a + 2.2 * b + 4.1 * c + 7.5 * d for a in range(17) for b in range(9) for c in range(5) for d in range(3) if a + 2 * b + 4 * c + 7 * d <= 16)
    assert math.isclose(sum(value[i] * k for i, k in got.items()), best)


def check_places(rows, table_rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for d, t in table_rows:
        ids = ids_of(t)
        want.update((d, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts(len(ids), 1024)))
    assert got == want
    return len(by), sum(r.length for r in rows)


def test_packing_is_whole_and_tight(spark):
    check_places(lp_packing.packed(table(spark).repartition(3)).collect(), [r[:2] for r in ROWS])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, total = check_places(lp_packing.packed(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.01 * total / 1024 + 1
    assert lp_packing.packed(table(spark).limit(0)).count() == 0
