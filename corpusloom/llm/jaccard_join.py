"""Exact n-gram Jaccard join with a token-group matrix.

Texts with equal shingle sets are one unit. Two units can only link if they share one of the first shingles of each in
a common order (the prefix that the threshold leaves). The order puts frequent shingles last, so most units share no
prefix shingle with any other; which shingles are frequent is counted over all documents, and any order gives the same
links. Units that share one are put into groups of similar ones, and the matrix, a stored table, has the union of each
group's shingles. A unit asks for the groups that it shares enough prefix shingles with; it meets a group's row of the
matrix first, and the members' sets travel, and are compared, only where the union holds enough of the unit's shingles.
This is done twice:

1. A group is the most common-place unit of each list of sharers. Near copies of one text mostly link to it, so they
   form classes at once.
2. Where a list still holds several classes, a group is units of about one size whose longest list is the same.

Shingle sets travel only for units that share a prefix shingle. No step pairs all members of a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import forget, pack, pack_sorted, settle, table, tidy, tidy_group, tidy_pair, unpack, unpack_sorted
from corpusloom.llm.components import components
from corpusloom.llm.shingles import Hashes, shingle_set

#: least intersection in hundredths of the union
PERCENT = 75
#: so many of the most frequent shingles go to the tasks (8 bytes each)
FREQUENT = 1 << 18
#: prefix shingles that a bucket holds, about, and bytes of one there, besides the bucket's own number
BUCKET_ITEMS, KEPT = 1_000_000, 6
#: units of a group, and units that one task compares with it
GROUP, QUERIES = 64, 256
#: largest ratio of two sizes in a group, about
SIZE_STEP = 1.1
#: bits of the filter of wanted documents: 1 MB
FILTER_BITS = 1 << 23


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set that it links to."""
    return -(-PERCENT * n // 100)


def enough(shared: Column, n: Column, last: Column, least: Column, most: Column, first_last: Column, last_last: Column) -> Column:
    """Whether a set of n shingles that shares ``shared`` prefix shingles with others can link to one of them.

    The others have least to most shingles and prefixes that end between first_last and last_last in the order. Up to
    the earlier of two prefixes' ends all common shingles are in both; beyond it at most what that set has left can be
    common, which is one less than its least overlap. Sets of a and b shingles link with 3 (a + b) / 7 common ones.
    """
    left = lambda k: F.ceil(PERCENT * k / 100) - 1
    needed = lambda other, rest: F.ceil(F.lit(PERCENT) * (n + other) / (100 + PERCENT)) - left(rest)
    ours, theirs = shared >= needed(least, n), shared >= needed(most, most)
    return (ours & (last <= last_last)) | (theirs & (last >= first_last))


def _key(found: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that most documents hold, FREQUENT at most, three documents at least: those that the order puts last.

    Texts of one set count once for each batch that holds them.
    """
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sets = {s.tobytes() for s in (shingle_set(t.as_py(), hashes) for t in batch.column(0))}
            found, n = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_counts=True)
            ends = [*np.searchsorted(found, np.arange(buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)).tolist(), len(found)]
            parts = [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int64()), pa.array([pack_sorted(found[p]) for p in parts], pa.binary()), pa.array([pack(n[p].astype(np.uint32)) for p in parts], pa.binary())], ["bucket", "found", "n"])

    def add(rows: pa.Table) -> pa.Table:
        found = np.concatenate([unpack_sorted(x) for x in rows["found"].to_pylist()])
        n = np.concatenate([unpack(x, "<u4") for x in rows["n"].to_pylist()])
        found, at = np.unique(found, return_inverse=True)
        n = np.bincount(at, n, len(found)).astype(np.int64)
        return pa.table({"shingle": found[n > 2].view(np.int64), "n": n[n > 2]})

    counted = settle(docs.select("text").mapInArrow(tidy(count), "bucket long, found binary, n binary").groupBy("bucket").applyInArrow(tidy_group(add), "shingle long, n long"))
    # as many as a bound on the count lets through; a sort would bring every task's most frequent ones to the driver
    size = F.floor(8 * F.log2("n")).cast("int")
    held, least = 0, None
    for r in sorted(counted.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["size"]
    top = counted.where(size >= least).select("shingle").toArrow()["shingle"].to_numpy() if least is not None else np.zeros(0, np.int64)
    forget(counted)
    return np.sort(top.view(np.uint64))


def _prefix(found: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The first shingles of a set in the order, how many of the set aren't frequent, and the last one's place in the order."""
    at = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
    often = frequent[at] == found if len(frequent) else np.zeros(len(found), bool)
    n = len(found) - least_overlap(len(found)) + 1
    rare = found[~often]
    if len(rare) >= n:
        return rare[:n], len(rare), int(rare[n - 1] >> np.uint64(2))
    first = np.concatenate([rare, found[often][: n - len(rare)]])
    return first, len(rare), int(first[-1] >> np.uint64(2)) + (1 << 62)


UNITS = "uid long, doc_id long, n long, k1 long, k2 long, rare long, last long"
PACKED = UNITS + ", bucket long, base long, shingles binary, places binary"


def _scan(frequent: np.ndarray, buckets: int):
    """(doc_id, text) to a row for each document and, apart, for each batch and bucket the prefix shingles."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.int64()] * 9 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, firsts, seen = [], [], set()
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                found = shingle_set(text.as_py(), hashes)
                first, rare, last = _prefix(found, frequent) if len(found) else (found, 0, 0)
                key = _key(found)
                rows.append((base + i, doc_id, len(found), *key, rare, last))
                if key not in seen and len(found):
                    seen.add(key)
                    firsts.append((i, first))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.nulls(len(rows), t) for t in kinds[7:]], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)
            if firsts:
                shingles = np.concatenate([f for _, f in firsts])
                places = np.repeat(np.array([i for i, _ in firsts], np.uint32), [len(f) for _, f in firsts])
                at = (shingles % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                at, shingles, places = at[order], shingles[order], places[order]
                own, starts = np.unique(at, return_index=True)
                ends = [*starts[1:].tolist(), len(at)]
                left = (shingles // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]
                cells = [(int(b), base, left[x:y].tobytes(), pack(np.diff(places[x:y], prepend=np.uint32(0)))) for b, x, y in zip(own, starts.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), t) for t in kinds[:7]] + [pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds[7:], strict=True)], names)
            base += batch.num_rows

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Of a bucket: (shingle, uid, k) of the shingles that k documents have, two at least.

    A bucket has KEPT bytes of a shingle, and its own number tells the rest of some 56 bits, more with more buckets.
    Two shingles that these take for one only make a list longer.
    """
    flat = np.frombuffer(b"".join(rows["shingles"].to_pylist()), np.uint8).reshape(-1, KEPT)
    whole = np.zeros((len(flat), 8), np.uint8)
    whole[:, :KEPT] = flat
    own = xxhash.xxh3_64_intdigest(rows["bucket"][0].as_py().to_bytes(8, "little"))
    shingles = whole.view("<u8").ravel() + np.uint64(own)
    places = [unpack(p, "<u4").cumsum(dtype=np.uint32) for p in rows["places"].to_pylist()]
    uids = np.concatenate([p.astype(np.int64) + b for p, b in zip(places, rows["base"].to_pylist(), strict=True)])
    order = np.argsort(shingles, kind="stable")
    shingles, uids = shingles[order], uids[order]
    same = shingles[1:] == shingles[:-1]
    often = np.r_[same, False] | np.r_[False, same]
    k = np.unique(shingles[often], return_counts=True)[1]
    return pa.table({"shingle": shingles[often].view(np.int64), "uid": uids[often], "k": np.repeat(k, k)})


def _filter_of(ids: DataFrame) -> np.ndarray:
    """Bits set for the documents of (doc_id); a false hit costs time only."""
    at = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    hashed = ids.where("doc_id IS NOT NULL").select(F.explode(F.array(F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1)))).alias("h"))
    rows = hashed.select((at / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.astype(np.uint32)


def _bit_places() -> tuple[Column, Column]:
    return tuple(F.pmod(F.xxhash64("doc_id", F.lit(1)) if k else F.xxhash64("doc_id"), F.lit(FILTER_BITS)) for k in range(2))


def _held(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether both places of an id are set."""
    return ((bits[a // 32] >> (a % 32).astype(np.uint32)) & (bits[b // 32] >> (b % 32).astype(np.uint32)) & 1).astype(bool)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but the rows with an id of gone (doc_id); only rows that a filter of these ids lets through are shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(gone))

    @F.arrow_udf(T.BooleanType())
    def maybe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array(_held(bits.value, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))))

    hit = maybe(*_bit_places())
    return docs.where(~hit).union(docs.where(hit).join(gone, "doc_id", "left_anti").select(*docs.columns))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles binary) for the units of wanted (rep, k1, k2, doc_id): only documents that may be theirs are read in full."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted.select("doc_id")))
    h = _bit_places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            hit = _held(bits.value, a, b)
            hit |= batch.column(0).is_null().to_numpy(zero_copy_only=False)
            sets = [shingle_set(batch.column(3)[i].as_py(), hashes) for i in np.flatnonzero(hit).tolist()]
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["k1", "k2", "shingles"])

    got = docs.select("doc_id", h[0].alias("a"), h[1].alias("b"), "text").mapInArrow(tidy(run), "k1 long, k2 long, shingles binary")
    # a key has one unit, so one row for each key is one for each unit, and the join's partitioning serves both
    return settle(got.join(wanted.select("k1", "k2", "rep"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("rep", "shingles"))


def _sets(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]


def _union(rows: pa.Table) -> pa.Table:
    """The matrix's row of a group."""
    union = np.unique(np.concatenate(_sets(rows)))
    return pa.table({"g": rows["g"][:1], "shingles": pa.array([union.tobytes()], pa.binary())})


def matrix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, shingles): the union of the sets of each group's members (g, rep)."""
    return settle(members.select("g", "rep").join(sets, "rep").select("g", "shingles").groupBy("g").applyInArrow(tidy_group(_union), "g long, shingles binary"))


def _qualify(asks: pa.Table, unions: pa.Table) -> pa.Table:
    """Of the units that ask for a group those of whose shingles its union holds enough."""
    if not unions.num_rows:
        return asks.select(["g", "rep", "cls"]).slice(0, 0)
    union = _sets(unions)[0]
    keep = []
    for own in _sets(asks):
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        keep.append(int((union[at] == own).sum()) >= least_overlap(len(own)))
    return asks.select(["g", "rep", "cls"]).filter(pa.array(keep, pa.bool_()))


def _compare(rows: pa.Table) -> pa.Table:
    """Links (u, v) between the queries and the members that came to one place; classes that are one already are left out."""
    sets = _sets(rows)
    rep, cls = rows["rep"].to_numpy(), rows["cls"].to_numpy()
    asks = rows["asks"].to_numpy(zero_copy_only=False).astype(bool)
    members, links = np.flatnonzero(~asks), []
    if len(members):
        flat = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        size = np.array([len(sets[i]) for i in members])
        for q in np.flatnonzero(asks).tolist():
            own = sets[q]
            a, b = np.searchsorted(flat, own, side="left"), np.searchsorted(flat, own, side="right")
            n = b - a
            hits = owner[np.repeat(a - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())]
            both = np.bincount(hits, minlength=len(members))
            linked = (100 * both >= PERCENT * (len(own) + size - both)) & (rep[members] != rep[q]) & (cls[members] != cls[q])
            links += [(int(rep[q]), int(rep[members[j]])) for j in np.flatnonzero(linked)]
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})


def _places(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, place, ...) for each unit that asks, about QUERIES of a group to a place; (g, place) for all places."""
    sizes = asks.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("places"))
    asking = asks.join(sizes, "g").select("g", F.pmod(F.xxhash64("rep"), F.col("places")).alias("place"), "rep", "cls")
    return asking, sizes.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"))


def linked(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between each unit of asks (g, rep, cls) and the members (g, rep, cls) of the group g.

    Only groups whose row of the matrix holds enough of a unit's shingles are opened to it. A group that many units ask
    for comes to as many places as keep a place at about QUERIES of them.
    """
    rows = matrix(members, sets)
    asking, places = _places(asks)
    of = asking.join(sets, "rep").groupBy("g", "place").cogroup(rows.join(places, "g").groupBy("g", "place"))
    fit = settle(of.applyInArrow(tidy_pair(_qualify), "g long, rep long, cls long"))
    asking, places = _places(fit)
    there = members.join(places, "g").select("g", "place", "rep", "cls", F.lit(False).alias("asks"))
    return asking.withColumn("asks", F.lit(True)).union(there).join(sets, "rep").groupBy("g", "place").applyInArrow(tidy_group(_compare), "u long, v long")


def met_groups(listed: DataFrame) -> DataFrame:
    """The units of each list with the groups there that they may ask for, from (shingle, rep, cls, n, last, s, g), s the lists of rep.

    Of two classes that of the larger number asks. No two units share more lists than each of them is in, so where that
    is too few for a link they don't meet.
    """
    ranges = [f(c).alias(name) for c, f, name in (("cls", F.min, "lo"), ("s", F.max, "gs"), ("n", F.min, "least"), ("n", F.max, "most"), ("last", F.min, "first_last"), ("last", F.max, "last_last"))]
    held = listed.groupBy("shingle", "g").agg(*ranges)
    fits = (F.col("lo") < F.col("cls")) & (100 * F.col("most") >= PERCENT * F.col("n")) & (PERCENT * F.col("least") <= 100 * F.col("n"))
    of = [F.col(c) for c in ("n", "last", "least", "most", "first_last", "last_last")]
    return listed.drop("g").join(held, "shingle").where(fits & enough(F.least("s", "gs"), *of))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    component_id is the smallest doc_id that links lead to. Documents without words have no shingles and are alone,
    as are their repeats. Rows with a null id take part; a component in which all ids are null has a null id. Repeated
    rows are units of one another. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs = docs.count()
    spark = docs.sparkSession
    frequent = frequent_shingles(docs)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * n_parts, n_docs * 150 // BUCKET_ITEMS)
    scanned = settle(docs.mapInArrow(tidy(_scan(frequent, buckets)), PACKED))
    rows = settle(scanned.where("uid IS NOT NULL").select(*(c.split()[0] for c in UNITS.split(", "))))
    with_set = rows.where("n > 0")
    units = settle(with_set.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "rare", "last"))))
    shared = scanned.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(tidy_group(_shared), "shingle long, uid long, k long")
    of = with_set.select("uid", "k1", "k2").join(units, ["k1", "k2"]).select("uid", "rep", "n", "rare", "last")
    lists = settle(shared.join(of, "uid").groupBy("shingle", "rep").agg(*(F.first(c).alias(c) for c in ("n", "rare", "last", "k"))))
    forget(scanned)
    lead = settle(lists.groupBy("shingle").agg(F.min(F.struct("rare", "rep", "n", "last")).alias("l"), F.count(F.lit(1)).alias("units")).where("units > 1"))

    # step 1: each list's most common-place unit, the one with the fewest rare shingles
    close = (100 * F.least("n", "l.n") >= PERCENT * F.greatest("n", "l.n")) & (F.col("rep") != F.col("l.rep"))
    met = lists.join(lead.select("shingle", "l"), "shingle").where(close).select(F.col("l.rep").alias("g"), "rep", "n", "last", F.col("l.n").alias("gn"), F.col("l.last").alias("gl")).distinct()
    # first by how many lists each of the two is in, which they can't share more of, then by those that they do share
    gn, gl = F.col("gn"), F.col("gl")
    each = settle(lists.groupBy("rep").agg(F.count(F.lit(1)).alias("s")))
    met = met.join(each, "rep").join(each.select(F.col("rep").alias("g"), F.col("s").alias("gs")), "g")
    met = settle(met.where(enough(F.least("s", "gs"), F.col("n"), F.col("last"), gn, gn, gl, gl)).drop("s", "gs"))
    both = met.join(lists.select("shingle", "rep"), "rep").join(lists.select("shingle", F.col("rep").alias("g")), ["shingle", "g"])
    counted = both.groupBy("g", "rep", "n", "last", "gn", "gl").agg(F.count(F.lit(1)).alias("c"))
    stars = settle(counted.where(enough(F.col("c"), F.col("n"), F.col("last"), gn, gn, gl, gl)).select("g", "rep"))
    wanted = stars.select("rep").union(stars.select("g")).distinct()
    sets = shingle_sets(docs, units.join(wanted, "rep"))
    hubs = stars.select("g").distinct()
    links = settle(linked(stars.select("g", "rep", F.col("rep").alias("cls")), hubs.select("g", F.col("g").alias("rep"), F.col("g").alias("cls")), sets))
    classes = settle(components(links))

    # step 2: lists that still hold several classes
    cls = F.coalesce("component", "rep").alias("cls")
    placed = settle(lists.join(classes, F.col("rep") == F.col("node"), "left").select("shingle", "rep", "n", "last", "k", cls))
    mixed = placed.groupBy("shingle").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("shingle")
    open_ = settle(placed.join(mixed, "shingle"))
    # groups: units whose longest list is the same, of about one size, all or none in enough lists for a partner of their size
    anchor = open_.groupBy("rep").agg(F.max(F.struct("k", "shingle")).alias("a"), F.count(F.lit(1)).alias("s"), *(F.first(c).alias(c) for c in ("cls", "n", "last")))
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("a.k") / GROUP))
    n, last = F.col("n"), F.col("last")
    able = enough(F.col("s"), n, last, n, n, last, last)
    members = settle(anchor.select("rep", "cls", "n", "last", "s", F.xxhash64(F.col("a.shingle"), F.floor(F.log("n") / math.log(SIZE_STEP)), part, able).alias("g")))
    of = [F.col(c) for c in ("n", "last", "least", "most", "first_last", "last_last")]
    pairs = met_groups(open_.join(members.select("rep", "g", "s"), "rep")).groupBy("g", "rep", "cls", "n", "last").agg(
        F.count(F.lit(1)).alias("c"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("first_last").alias("first_last"), F.max("last_last").alias("last_last")
    )
    asks = settle(pairs.where(enough(F.col("c"), *of)).select("g", "rep", "cls"))
    opened = settle(members.join(asks.select("g").distinct(), "g", "left_semi").select("g", "rep", "cls"))
    lacking = asks.select("rep").union(opened.select("rep")).distinct().join(wanted, "rep", "left_anti")
    sets = sets.union(shingle_sets(docs, units.join(lacking, "rep")))
    more = linked(asks, opened, sets)
    final = settle(components(links.union(more)))

    least = units.join(final, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"), "doc_id")
    least = settle(least)
    ids = least.join(least.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("k1", "k2", "component_id")
    joined = rows.where("n > 0").join(ids, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.union(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest doc_id.

    Of repeated rows of that id one stays. Rows with a null id or without words have no partner to yield to and stay.
    """
    got = settle(jaccard_components(docs))
    by_id = got.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n"))
    lone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    if by_id.where("n > 1").limit(1).count() or got.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").limit(1).count():  # repeated ids
        stay = by_id.where("n > 0").select("doc_id")
        kept = docs.where(~lone).join(stay, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        return kept.union(docs.where(lone))
    return without(docs, by_id.where("n = 0").select("doc_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jaccard_components`` of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))
