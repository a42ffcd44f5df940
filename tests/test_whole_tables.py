"""Queries that take their whole table, against plain Python on small tables of their own."""

import duckdb

from corpusloom.plans.registry import ORACLES, QUERIES


def test_every_part_has_a_place(spark, tmp_path):
    rows = [(i, i * 7 % 50) for i in range(1, 402)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.phase: r.place for r in QUERIES["srt04_semantic_order_part"](spark, str(tmp_path)).collect()}
    want = {}
    for family in range(12):
        own = sorted((size, key) for key, size in rows if key % 12 == family)
        want |= {f"{family}.{size}.{key}": place for place, (size, key) in enumerate(own, 1)}
    assert got == want


def test_every_word_of_a_text_is_bared(spark, tmp_path):
    texts = {1: " ".join(f"(Word{i % 90}, x{i}!" for i in range(300)), 2: "One 'two' TWO.", 3: " \n", 4: None, 5: "... a"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.chars) for r in QUERIES["str18_bare_documents"](spark, str(tmp_path)).collect()}
    bare = {d: [w.strip(".,;:?!\"'“”‘’()[]").lower() for w in (t or "").split()] for d, t in texts.items()}
    assert got == {d: (len(set(b)), sum(map(len, b))) for d, b in bare.items() if b}


def test_refinements_count_markers_as_words_and_no_null_roles(spark, tmp_path):
    rows = [(1, 0, "user", "a b c d e f g h"), (1, 1, "bot", "- one two three four five"), (1, 2, None, "a b c d e f g h"), (1, 3, "bot", "> a b c d e f g")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = duck.sql(ORACLES["agg22_refinements_conversations"]).fetchall()
    assert [tuple(r) for r in QUERIES["agg22_refinements_conversations"](spark, str(tmp_path)).collect()] == want
    assert want == [(1, 0, 1, 2)]
