"""Steps whose work must not grow with queries times rows in one place: results beside brute force, and how they are got."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import fulltext, kv, memory, vector
from quern.sources import table_file


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    return spark.createDataFrame([(i, " ".join(rng.sample(words, rng.randrange(0, 30)))) for i in range(400)], "doc_id bigint, text string").repartition(7)


def test_ranking_adds_scores_up_inside_tasks(spark, texts, tmp_path, monkeypatch):
    asked = texts.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = fulltext.Index(spark, str(tmp_path)).add(texts).search(asked, 5)
    assert "keys=[query_id" not in plan(got).replace("keys=[query_id#", "keys=[query_id")  # no rows of queries and documents are grouped
    tf, stats = fulltext.term_freq(texts), fulltext.corpus_stats(texts).first()
    posts = tf.join(fulltext.term_stats(tf, fulltext.corpus_stats(texts)), "term").join(fulltext.lengths(texts), "doc_id")
    part = F.expr(f"idf * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * doc_len / {stats['avgdl']!r}D))")
    scored = posts.withColumn("part", part).join(fulltext._wanted(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.expr("part * weight")).alias("score"))
    want = {}
    for r in sorted(scored.collect(), key=lambda r: (r["query_id"], -round(r["score"], 9), r["doc_id"])):
        want.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    want = {q: best[:5] for q, best in want.items()}
    seen = {}
    for r in got.orderBy("query_id", "rank").collect():
        seen.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    assert seen == want


def test_idf_counts_rows_of_one_document_once(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red"), (3, ""), (4, None)], "doc_id bigint, text string")
    assert {r["term"]: (r["df"], round(r["idf"], 6)) for r in fulltext.idf(docs).collect()} == {"red": (2, round(float(np.log(1 + 0.5 / 2.5)), 6)), "blue": (1, round(float(np.log(2)), 6))}
    again = docs.unionByName(docs.where("doc_id = 1"))
    assert {r["term"]: r["df"] for r in fulltext.idf(again).collect()} == {"red": 2, "blue": 1}


def test_places_of_a_chat_need_no_corpus(spark):
    said = spark.createDataFrame([("a", 2, "find x"), ("a", 1, "hello"), ("b", 3, None)], "session_id string, msg_id bigint, text string")
    got = memory.chat(said, None, None, 0, F.lit("2024-01-01")).places.collect()
    assert sorted(map(tuple, got)) == [("a", 1, 0, "system"), ("a", 1, 1, "user"), ("a", 1, 2, "assistant"), ("a", 2, 1, "user"), ("a", 2, 2, "assistant"), ("b", 3, 0, "system"), ("b", 3, 1, "user"), ("b", 3, 2, "assistant")]


def test_a_task_holds_a_bounded_block_of_distances(spark):
    ids = np.arange(2000)
    rows = spark.range(5000).select(F.col("id").alias("vec_id")).coalesce(1)

    def score(b):
        d = np.abs(ids[:, None] - b.column("vec_id").to_numpy())
        assert d.size <= 1 << 20, "too many distances at once"
        return d.astype(float)

    got = {}
    for r in vector.tops(rows, ids, score, 3).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {i: {i - 1, i, i + 1} if i else {0, 1, 2} for i in range(2000)}


def test_knn_keeps_ties_by_id(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 8)), np.zeros((3, 8)), 1e6 * rng.normal(size=(20, 8))])
    x = np.concatenate([x, x[::-1]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    got = vector.knn(rows, rows.withColumnRenamed("vec_id", "query_id"), 4)
    for q in range(len(x)):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(len(x)), d.round(9)))[:4].tolist()
        assert [r["vec_id"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want if q % 25 == 0 else True


def test_a_graph_is_the_same_from_known_distances():
    x = np.random.default_rng(1).normal(size=(150, 6))
    made = []
    for known in (None, vector.distances("l2", x, x).tolist()):
        g = vector.Graph(x, m=4, ef_build=20, between=known)
        for i in range(len(x)):
            g.insert(i, 1 if i % 9 == 0 else 0)
        made.append(g.links)
    assert made[0] == made[1]


def test_overlaps_meet_by_cells(spark):
    rng = random.Random(2)
    spans = [(i, *sorted(f"k{rng.randrange(300):03d}" for _ in range(2))) for i in range(300)] + [(900 + i, "k010", "k290") for i in range(40)]
    meta = spark.createDataFrame(spans, "id bigint, smallest string, largest string")
    got = kv.overlaps(meta.where("id % 2 = 0"), meta.where("id % 2 = 1"))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    want = sorted((u[0], low[0]) for u in spans for low in spans if u[0] % 2 == 0 and low[0] % 2 == 1 and low[2] >= u[1] and low[1] <= u[2])
    assert sorted(map(tuple, got.collect())) == want


def test_more_table_files_than_are_held_at_once(spark):
    log = spark.range(4 * table_file.FILES + 3).selectExpr("id", "id as seq", "1 as op", "concat('k', id) as key", "'v' as value")
    got = table_file.scanned(table_file.images(log).coalesce(1)).collect()
    assert sorted((r["id"], r["seq"], bytes(r["key"])) for r in got) == [(i, i, b"k%d" % i) for i in range(4 * table_file.FILES + 3)]
