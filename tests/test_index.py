import random

import pytest
from delvework.functions import text as T
from delvework.operators import index, modules, search, vectors
from delvework.sources import files
from pyspark.sql import functions as F

FILE = "file_path string, module string, content string, version long"


def tree(spark, rnd, n, docs=False):
    body = lambda: "\n".join(rnd.choice(["fn f() {\n}", "# Head", "x", "", "let a = 1;"]) for _ in range(rnd.randrange(1, 9)))
    return [(f"{'modules' if docs else 'src'}/d{k % 5}/f{k}.{'md' if docs else rnd.choice(['rs', 'sh', 'h'])}", f"d{k % 5}", body(), 0) for k in range(n)]


def state(store, *names):
    return {n: sorted(tuple(map(str, r)) for r in store.read(n).drop("last_indexed").collect()) for n in names}


def test_changes_to_code_documents_and_vectors_equal_a_new_build(spark, tmp_path):
    rnd = random.Random(3)
    code, docs = tree(spark, rnd, 30), tree(spark, rnd, 12, docs=True)
    df = lambda rows: spark.createDataFrame(rows, FILE).drop("version")
    inc, full = index.Snapshots(spark, str(tmp_path / "inc")), index.Snapshots(spark, str(tmp_path / "full"))
    names = ("chunks", "docs", "hashes", "vectors")
    for step in range(3):
        index.build(spark, df(code), inc.folder, now=step, docs=df(docs), provider=vectors.hashed_embedding, buckets=8)
        index.build(spark, df(code), full.folder, now=step, force=True, docs=df(docs), provider=vectors.hashed_embedding, buckets=8)
        got = state(inc, *names)
        assert got == state(full, *names) and all(got.values())
        assert {r.id for r in inc.read("vectors").collect()} == {r.id for n in ("chunks", "docs") for r in inc.read(n).collect()}
        code[step] = (*code[step][:2], "fn changed() {\n}\n", 0)
        docs[step] = (*docs[step][:2], "# changed\nx", 0)
        del code[10 + step], docs[5 + step]
    one = index.describe(inc).first()
    assert one["chunks"] == inc.read("chunks").count() and one.doc_chunks == inc.read("docs").count() and one["vectors"] == one["chunks"] + one.doc_chunks and one.dimension == 64 and one.model == "hashed_embedding"
    assert {c for c in inc.read("docs").columns} >= {"section"} and "symbol_name" in inc.read("chunks").columns


def test_a_small_change_leaves_the_other_parts(spark, tmp_path):
    store, rows = index.Snapshots(spark, str(tmp_path)), [(f"a/f{k}.rs", "a", f"fn f{k}() {{\n}}", 0) for k in range(60)]
    df = lambda: spark.createDataFrame(rows, FILE)
    index.build(spark, df(), store.folder, buckets=16)
    before = store.meta()["tables"]["chunks"]["parts"]
    rows[7] = ("a/f7.rs", "a", "fn g() {\n}", 1)
    index.build(spark, df(), store.folder, buckets=16)
    after = store.meta()["tables"]["chunks"]["parts"]
    assert len([b for b in before if before[b] != after[b]]) == 1 and len(before) > 8
    index.build(spark, df(), store.folder, buckets=16)
    assert store.meta()["tables"]["chunks"]["parts"] == after and store.read("chunks").count() == 60


def test_partial_builds_by_version(spark, tmp_path):
    store = index.Snapshots(spark, str(tmp_path))
    df = lambda *rows: spark.createDataFrame(rows, FILE)
    symbols = lambda: sorted((r.file_path, r.symbol_name) for r in store.read("chunks").collect())
    sh = lambda n: f"{n}() {{\n}}"
    index.build(spark, df(("a.sh", "m", sh("a1"), 1), ("a.sh", "m", sh("a3"), 3), ("a.sh", "m", sh("a2"), 2), ("b.sh", "m", sh("b"), None), ("c.sh", "m", None, 1)), store.folder, partial=True)
    assert symbols() == [("a.sh", "a3"), ("b.sh", "b")]
    index.build(spark, df(("a.sh", "m", sh("late"), 2), ("c.sh", "m", sh("c"), 2)), store.folder, partial=True)
    assert symbols() == [("a.sh", "a3"), ("b.sh", "b"), ("c.sh", "c")]
    for _ in range(2):  # a batch that is run again leads to the same state
        index.build(spark, df(("b.sh", "m", None, 4), ("a.sh", "m", sh("a4"), 4)), store.folder, partial=True)
        assert symbols() == [("a.sh", "a4"), ("c.sh", "c")]
    assert sorted(r.path for r in store.read("hashes").collect()) == ["a.sh", "c.sh"]
    index.build(spark, df(), store.folder, partial=True)
    assert symbols() == [("a.sh", "a4"), ("c.sh", "c")]


def test_stream_with_versions(spark, tmp_path):
    from delvework.streaming.ingest import watch

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in ([("a.sh", "m", "f() {\n}", 1), ("b.sh", "m", "x() {\n}", 1)], [("a.sh", "m", "g() {\n}", 3), ("a.sh", "m", "h() {\n}", 2), ("b.sh", "m", None, 2)]):
        spark.createDataFrame(rows, FILE).write.mode("append").parquet(src)
        watch(spark, src, out, cp).awaitTermination(120)
    assert [r.symbol_name for r in index.Snapshots(spark, out).read("chunks").collect()] == ["g"]


@pytest.mark.parametrize(
    "rules, kept",
    [
        ({".gitignore": "*.js\n# no\n\n!keep.js\nout/\n/top.rs\na/**/z.rs\n"}, {"a/keep.js", "a/top.rs", "b/c/m.rs", "out.rs"}),
        ({".gitignore": "b\n", "a/.gitignore": "!x.js\n*.rs\r\n"}, {"a/x.js", "a/keep.js", "top.rs", "out.rs", "out/q.rs"}),
        ({"a/.gitignore": "/x.js\n/q/\n[kt]*.??\n"}, {"a/q/z.rs", "b/c/m.rs", "top.rs", "out.rs", "out/q.rs"} - {"a/q/z.rs"}),
    ],
)
def test_ignore_files(spark, tmp_path, rules, kept):
    for p in ("a/x.js", "a/keep.js", "a/top.rs", "a/q/z.rs", "b/c/m.rs", "top.rs", "out.rs", "out/q.rs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    for p, t in rules.items():
        (tmp_path / p).write_text(t)
    assert {r.file_path for r in files.scan(spark, str(tmp_path)).collect()} == kept
    assert files.scan(spark, str(tmp_path), ignore_name=None).count() == 8


def test_modules_from_files(spark):
    tree = spark.createDataFrame([("x/modules/a/STATUS", "partial:1"), ("x/modules/a/b/c/STATUS", None), ("modules/d/notes.md", "x"), ("STATUS", "y"), (None, "z")], "file_path string, content string")
    assert sorted((r.module_key, r.raw_status) for r in modules.registry(tree).collect()) == [("a", "partial:1"), ("a/b/c", None)]
    keys = spark.createDataFrame([("modules/a/b/api.md",), ("modules/solo.md",), ("c/x.md",)], "p string").select(modules.doc_key(F.col("p")).alias("k"))
    assert [r.k for r in keys.collect()] == ["a/b", "solo", "c"]
    mods = spark.createDataFrame([("a", "understood:5"), ("b", "outdated:5:x"), ("c", None)], "module_key string, raw_status string")
    asked = spark.createDataFrame([("a",), ("b",), ("d",), ("d",), (None,)], "module_key string")
    got = {r.module_key: r.raw_status for r in modules.analyzed(mods, asked, 9).collect()}
    assert got == {"a": "understood:5", "b": "analyzing:9", "c": None, "d": "analyzing:9"}
    assert {r.module_key: r.raw_status for r in modules.analyzed(mods, asked, 9, force=True).collect()}["a"] == "analyzing:9"
    assert {(r.state, r.outdated) for r in modules.overview(mods, 9).collect()} == {("understood", 1), ("outdated", 1), ("unknown", 1)}
    paths = spark.createDataFrame([("/r/src/a.rs",), ("./b.rs",), ("/else/c.rs",), ("C:\\r\\d.rs",)], "p string")
    assert [r.p for r in paths.select(T.relative_path(F.col("p"), "/r/").alias("p")).collect()] == ["src/a.rs", "b.rs", "/else/c.rs", "C:/r/d.rs"]
    assert spark.range(1).select(modules.safe_label(F.lit("a/b/c")).alias("s")).first().s == "a_b_c"


def test_documents_by_words_and_vectors(spark):
    rows = spark.createDataFrame([("a", "m", "retry the snapshot", None), ("b", "n", "snapshot", "retry"), ("c", "m", "nothing", None)], "id string, module string, content string, section string")
    vec = vectors.embed(rows, keep=("module",))
    asked = vectors.embed_query("nothing at all")
    near = vectors.near(vec, asked, 2)
    assert near.first().id == "c" and vectors.near(vec, asked, 5, module="n").first().id == "b"
    assert {r.id for r in search.search_docs(rows, "retry snapshot", near=near).collect()} == {"a", "b", "c"}
    assert [r.id for r in search.search_docs(rows, "retry snapshot").collect()] == ["b", "a"]
    assert vectors.near(vec.where("false"), asked, 2).count() == 0
