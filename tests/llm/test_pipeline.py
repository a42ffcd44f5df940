"""The pipeline's stages, each on what the one before kept."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import jaccard_join, rule_classifier, toxic_segments
from corpusloom.llm.queries import ORACLES, QUERIES
from corpusloom.llm.topk_search import op3_topk_search


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = c.sql(ORACLES[name]).project(", ".join(f'"{x}"' for x in columns)).fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_ten_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and op3_topk_search in QUERIES.values()


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = docs.count(), out.select("doc_id").distinct().count()
        assert after == before if name == "packing" else 0 < after <= before
        if name == "toxicity":
            gone = docs.join(out, "doc_id", "left_anti").join(labels, "doc_id")
            assert gone.where("toxic = 0").count() <= 0.02 * before
        if name == "near_copies":
            assert jaccard_join.jaccard_components(out).where("component_id <> doc_id").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, small).count() > 0


def written(spark, folder, docs, labels):
    """A folder of tables as the pipeline reads them: odd rows, repeats and names that stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, mix_topic string, text_stats string, toxicity string, uid string"
    spark.createDataFrame([(*d, None, "a", "b", "c", "d", "e") for d in docs], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def through(spark, sf_dir):
    """Each stage's result, written and read again as the next one's input."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{sf_dir}/stage{k}")
        docs = spark.read.parquet(f"{sf_dir}/stage{k}")
        found.append(docs)
    return found


def test_stages_on_odd_rows(spark, tmp_path):
    r = random.Random(2)
    word = lambda: f"word{r.randrange(3000)}"
    good = [(i, " ".join(word() for _ in range(r.randrange(60, 200))) + ".", r.choice(["en", None]), r.choice(["a", "b", None])) for i in range(120)]
    bad = [(200 + i, "## $$ ** " * 40, "en", "a") for i in range(60)]
    toxic = [(300 + i, " ".join(word() if k % 6 else "vilename" for k in range(90)), "en", "b") for i in range(60)]
    copy = [(400, good[0][1], "en", "a"), (401, good[0][1] + " more", "en", "a"), (402, good[1][1], None, None), (good[2][0], *good[2][1:])]
    odd = [(500, None, "en", "a"), (501, "", None, "a"), (None, good[3][1] + " x", "en", "b"), (None, None, None, None), (502, "y" * 100_000, "en", "a")]
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(i, 1, 1) for i, *_ in toxic] + [(500, 0, 0), (501, 0, 0), (None, 1, 1), (5, None, None)]
    clean, fine, lone, mixed, packed = through(spark, written(spark, tmp_path, good + bad + toxic + copy + odd, labels))
    ids = lambda df: Counter(x.doc_id for x in df.select("doc_id").collect())
    a, b, c, d = map(ids, (clean, fine, lone, mixed))
    assert not {i for i in a if i is not None} & {i for i, *_ in toxic} and all(a[i] for i, *_ in good) and a[2] == 2 and a[None] == 2
    assert not set(b) & {i for i, *_ in bad} and all(b[i] for i, *_ in good)
    assert c[0] == 1 and not c[400] and not c[401] and c[1] == 1 and not c[402] and c[2] == 1 and all(c[i] == 1 for i in range(3, 120)) and c[None] == b[None]
    assert 0 < sum(d.values()) < sum(c.values()) and all(d[i] <= c[i] for i in d)
    got = ids(packed.where("piece = 0"))
    assert got == d


def test_stages_on_empty_tables_and_without_labels(spark, tmp_path):
    assert [x.count() for x in through(spark, written(spark, tmp_path / "none", [], []))] == [0] * 5
    rows = [(i, f"some text {i} of its own " * 20, "en", "a") for i in range(5)]
    found = through(spark, written(spark, tmp_path / "unlabelled", rows, []))
    assert [x.count() for x in found] == [5, 0, 0, 0, 0]  # no label says what is toxic or good


def test_filters_are_the_operators_scores(spark, small):
    """What the filtering stages keep is what plain comparisons of the operators' scores keep, row by row."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxic_segments.score_documents(docs, toxic_segments.train(docs, labels), "t").select("doc_id", F.col("t.score").alias("t")).collect()
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, small).collect()) == sorted(r.doc_id for r in scored if r.t < corpus_pipeline.TOXIC)
    scored = rule_classifier.score_documents(docs, rule_classifier.train(docs, labels), "q").select("doc_id", "q").collect()
    assert sorted(r.doc_id for r in corpus_pipeline.keep_good(spark, docs, small).collect()) == sorted(r.doc_id for r in scored if r.q >= corpus_pipeline.GOOD)
    assert zlib.crc32(b"1") % 4 == spark.range(1, 2).select(rule_classifier.crc_mod(F.col("id"), 4)).first()[0]
