import sqlite3

import pytest
from delvework.operators import bm25, fusion, search, vectors

ROWS = [
    ("a", "core", "the reader reads a snapshot and the snapshot is read", "readSnapshot"),
    ("b", "core", "a reader of nothing", "walk"),
    ("c", "ui", "aaaaa aaaa", None),
    ("d", "ui", "合并模块的快照", "mergeAll"),
    ("e", "ui", "ÄÖÜ and AND OR near", "snapshot"),
    ("f", "ui", None, "readerOfSnapshots"),
    ("g", "core", "aaa", "x"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, module string, content string, symbol_name string")


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def fts(query, module=None):
    """What a public full-text engine with trigrams and the same weights returns: ids by score."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, module UNINDEXED, content, symbol_name, tokenize='trigram')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, m, c or "", s or "") for i, m, c, s in ROWS])
    return con.execute("SELECT id, -bm25(t, 0, 0, 1.0, 10.0) FROM t WHERE t MATCH ? ORDER BY 2 DESC, id", (query,)).fetchall()


@pytest.mark.parametrize("words", [["snapshot"], ["reader", "snapshot"], ["aaa"], ["reader", "aaa"], ["äöü"]])
def test_bm25_equals_full_text_engine(spark, rows, words):
    got = bm25.trigram_scored(rows, words, search.CODE_WEIGHTS).collect()
    want = fts(" OR ".join(f'"{w}"' for w in words))
    assert sorted((r.id, round(r.score, 5)) for r in got) == sorted((i, round(s, 5)) for i, s in want)
    assert {r.id for r in got if r.all_terms} == {i for i, _ in fts(" AND ".join(f'"{w}"' for w in words))}


def test_module_filter_keeps_statistics(spark, rows):
    all_ = {r.id: r.score for r in bm25.trigram_scored(rows, ["snapshot"], search.CODE_WEIGHTS).collect()}
    core = search.keyword(rows, "snapshot", search.CODE_WEIGHTS, 10, "core").collect()
    assert [(r.id, r.score) for r in core] == [("a", all_["a"])]


def test_cascade(spark, rows):
    assert ids(search.keyword(rows, "reader snapshot", search.CODE_WEIGHTS, 10)) == ids(fusion.top(bm25.trigram_scored(rows, ["reader", "snapshot"], search.CODE_WEIGHTS).where("all_terms"), 10))
    # no row has all: any will do; a short word beside long ones matches nothing
    assert set(ids(search.keyword(rows, "reader zzzz", search.CODE_WEIGHTS, 10))) == {"a", "b", "f"}
    assert set(ids(search.keyword(rows, "nothing of", search.CODE_WEIGHTS, 10))) == {"b"}
    # reserved words are words
    assert ids(search.keyword(rows, "AND", search.CODE_WEIGHTS, 10)) and ids(search.keyword(rows, "near", search.CODE_WEIGHTS, 10)) == ["e"]
    assert ids(search.keyword(rows, "", search.CODE_WEIGHTS, 10)) == []


def test_short_words_and_exact(spark, rows):
    got = search.keyword(rows, "of a", search.CODE_WEIGHTS, 10).collect()
    assert {r.id for r in got} == {"b", "f"} and {r.score for r in got} == {1.0}
    assert ids(search.search(rows, 'a "reader" of', exact=True)) == ["b"]
    assert ids(search.search(rows, "re", exact=True)) == [] and ids(search.search(rows, '""', exact=True)) == []


def test_cjk(spark, rows):
    assert ids(search.keyword(rows, "合并块的", search.CODE_WEIGHTS, 10)) == ["d"]
    assert ids(search.keyword(rows, "模块合并", search.CODE_WEIGHTS, 10)) == ["d"]  # falls back to any bigram
    assert ids(search.keyword(rows, "合并 reader", search.CODE_WEIGHTS, 10))[0] in {"a", "b", "d", "f"}


def test_repeated_chunks_count_once(spark, rows):
    from pyspark.sql import functions as F

    twice = rows.withColumn("last_indexed", F.lit(1).cast("long")).unionByName(rows.withColumn("last_indexed", F.lit(2).cast("long"))).unionByName(rows.where("id = 'a'").select(F.lit(None).cast("string").alias("id"), "module", "content", "symbol_name", F.lit(3).cast("long").alias("last_indexed")))
    for q in ("snapshot", "of a", "合并", "reader zzzz"):
        assert [tuple(r) for r in search.keyword(twice, q, search.CODE_WEIGHTS, 10).orderBy("rank").collect()] == [tuple(r) for r in search.keyword(rows, q, search.CODE_WEIGHTS, 10).orderBy("rank").collect()]
    shown = search.results(search.keyword(twice, "snapshot", search.CODE_WEIGHTS, 2), twice.select("*", F.lit("p").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line")), 1).orderBy("rank").collect()
    assert [r["rank"] for r in shown] == [1, 2]


def lists(spark, *ls):
    return [spark.createDataFrame([(i, s, k + 1) for k, (i, s) in enumerate(x)], "id string, score double, rank int") for x in ls]


def test_fusion(spark):
    a, b = lists(spark, [("x", 9.0), ("y", 8.0)], [("y", 0.5), ("z", 0.4)])
    got = [(r.id, r.score) for r in fusion.fuse([a, b], 10).orderBy("rank").collect()]
    assert got == [("y", round(1 / 61 + 1 / 62, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]
    assert {r.id for r in fusion.fuse([b, a], 10).collect()} == {"x", "y", "z"}
    empty = a.where("false")
    assert [(r.id, r.score) for r in fusion.fuse([empty, a], 10).orderBy("rank").collect()] == [("x", 9.0), ("y", 8.0)]
    assert fusion.fuse([empty, empty], 10).count() == 0


def test_router(spark, rows):
    near = lists(spark, [("b", 0.9), ("g", 0.8), ("nowhere", 0.7)])[0]
    assert ids(search.search(rows, "snapshot", mode="keyword", near=near)) == ids(search.search(rows, "snapshot"))
    assert "g" in ids(search.search(rows, "snapshot", near=near))
    assert ids(search.search(rows, "snapshot", mode="semantic", near=near)) == ["b", "g", "nowhere"]
    with pytest.raises(ValueError):
        search.search(rows, "snapshot", mode="semantic")


def test_cosine(spark):
    from pyspark.sql import functions as F

    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([1.0], [1.0, 0.0], 0.0), ([0.0], [1.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"))
    assert [round(r.c, 6) for r in df.collect()] == [c for *_, c in cases]


def test_nearest_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(90)] + [(500, None), (501, [1.0])], "id long, vector array<float>")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in vectors.nearest(df, df.where("id % 10 = 0 AND id < 90"), 4, block=16).collect()}
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in range(0, 90, 10):
        s = np.round(u @ u[q], 6)
        s[q] = -2
        for k, i in enumerate(np.lexsort((np.arange(90), -s))[:4]):
            assert got[(q, k + 1)] == (i, s[i])
    assert len(got) == 36


def test_embedding_pass(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "x y"), ("b", "z"), (None, "q"), ("c", None)], "id string, content string")
    known = spark.createDataFrame([("b",)], "id string")
    got = vectors.embed(df, known=known).collect()
    assert [r.id for r in got] == ["a"] and len(got[0].vector) == 64
    with pytest.raises(Exception, match="vectors"):
        vectors.embed(df, provider=lambda texts: []).collect()
