import datetime

import pytest
from delvework.operators import index, listing, memory, modules
from delvework.sources import config, files
from pyspark.sql import functions as F

NOW = 1_900_000_000


def statuses(spark, raws):
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "module_key string, raw_status string")
    return [tuple(r)[1:] for r in modules.statuses(df, NOW).orderBy(F.col("module_key").cast("int")).collect()]


def test_status_grammar(spark):
    raws = ["unknown", "", None, " partial:1710000000\n", "understood:soon", "outdated:5:a:b", "outdated", "Understood:5", "half:5", "analyzing:-3"]
    assert statuses(spark, raws) == [
        ("unknown", None, None), ("unknown", None, None), ("unknown", None, None), ("partial", 1710000000, None), ("understood", NOW, None),
        ("outdated", 5, "a:b"), ("outdated", NOW, ""), ("unknown", None, None), ("unknown", None, None), ("analyzing", -3, None),
    ]


def test_status_round_trip_and_set(spark):
    raws = ["unknown", "partial:7", "outdated:8:x:y"]
    df = modules.statuses(spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "module_key string, raw_status string"), NOW)
    assert [r.t for r in df.orderBy("module_key").select(modules.status_text(F.col("state"), F.col("since"), F.col("reason")).alias("t")).collect()] == raws
    got = {r.module_key: (r.state, r.since, r.reason) for r in modules.set_status(df, ["0", "2"], "outdated", 9, "z").collect()}
    assert got == {"0": ("outdated", 9, "z"), "1": ("partial", 7, None), "2": ("outdated", 9, "z")}
    with pytest.raises(ValueError):
        modules.set_status(df, ["0"], "analyzing", 9)
    assert {r.state: r.n for r in modules.rollup(df).collect()} == {"unknown": 1, "analyzing": 0, "partial": 1, "understood": 0, "outdated": 1}


def test_changes_meet_modules_by_components(spark):
    mods = spark.createDataFrame([("src/a", "understood:5"), ("src/ab", "unknown"), ("_root_", "partial:6"), ("src", "outdated:7:r")], "module_key string, raw_status string")
    ch = spark.createDataFrame([(p,) for p in ("./src/a/x.rs", "src\\a\\x.rs", "src/ab/y.rs", "src/a", "top.rs", "lib/z.rs", None, "")], "path string")
    got = {(r.module_key, r.path) for r in modules.changes_by_module(ch, mods).collect()}
    assert got == {("src/a", "src/a/x.rs"), ("src", "src/a/x.rs"), ("src/ab", "src/ab/y.rs"), ("src", "src/ab/y.rs"), ("src/a", "src/a"), ("src", "src/a"), ("_root_", "top.rs")}
    assert [r.path for r in modules.unmatched(ch, mods).collect()] == ["lib/z.rs"]
    out = {r.module_key: r.new_status for r in modules.outdated(ch, mods, NOW).collect()}
    assert out == {"src/a": f"outdated:{NOW}:2 file(s) changed: a, x.rs", "src/ab": None, "_root_": f"outdated:{NOW}:1 file(s) changed: top.rs", "src": None}


def test_added_modules(spark):
    mods = spark.createDataFrame([("src/a", "partial:1")], "module_key string, raw_status string")
    keys = spark.createDataFrame([("src/a",), ("src/b",), ("nowhere",), ("_root_",)], "module_key string")
    paths = spark.createDataFrame([("src/b/c.rs",)], "path string")
    assert sorted((r.module_key, r.raw_status) for r in modules.added(mods, keys, paths).collect()) == [("_root_", "unknown"), ("src/a", "partial:1"), ("src/b", "unknown")]


def test_tags_and_dates(spark):
    text = "lead #a\n## one\n#ab\n## two #a\nx\n## three\ny #a z\n"
    df = spark.createDataFrame([("n.md", text), ("e.md", None)], "file_path string, content string")
    assert [r.block.split("\n")[0] for r in memory.with_tag(df, "a").collect()] == ["## one", "## three"]
    t = datetime.datetime
    notes = spark.createDataFrame(
        [(1, t(2030, 4, 1, 0, 0), "src/Search", "b", ["perf2"]), (1, t(2030, 4, 1, 0, 0), "src/Search", "b", ["perf2"]), (2, t(2030, 3, 31, 23, 59), None, "in SEARCH", None), (3, None, None, None, [None])],
        "note_id long, ts timestamp, module string, body string, tags array<string>",
    )
    assert [r.note_id for r in memory.notes_with_tag(notes, "perf").collect()] == [1]
    assert [r.note_id for r in memory.corrections(notes, "2030-04-01", "search").collect()] == [1]
    assert sorted(r.note_id for r in memory.corrections(notes, "no date", "search").collect()) == [1, 2]
    assert sorted(r.note_id for r in memory.corrections(notes).collect()) == [1, 2, 3]


def test_listing(spark):
    df = spark.createDataFrame([(p,) for p in ("a/x.rs", "a/y.RS", "a/b/z.rs", "a/b/Makefile", "a/x.rs", None)], "path string")
    got = {(r.directory, r.extension): r.files for r in listing.extension_counts(df, 1).collect()}
    assert got == {(".", "rs"): 3, ("a", "rs"): 3, (".", "~"): 1, ("a", "~"): 1}
    assert [(r.extension, r.files) for r in listing.languages(df).collect()] == [("rs", 3)]


def test_changed_files(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "5")], "path string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "x"), ("d", "4"), ("e", ""), (None, "9")], "path string, sha256 string")
    assert sorted((r.path, r.change) for r in index.changed(now, old).collect()) == [("b", "changed"), ("c", "new"), ("d", "gone"), ("e", "changed")]


def test_incremental_build_equals_full_build(spark, tmp_path):
    schema = "file_path string, module string, content string"
    one = spark.createDataFrame([("a.py", "m", "def f(): pass"), ("b.sh", "m", "x() {\n}"), ("c.md", "m", "# t\nx")], schema)
    two = spark.createDataFrame([("a.py", "m", "def g(): pass"), ("c.md", "m", "# t\nx"), ("d.rs", "m", "fn q() {}")], schema)
    cols = ["id", "content", "symbol_name"]
    inc, full = str(tmp_path / "inc"), str(tmp_path / "full")
    index.build(spark, one, inc, now=1)
    index.build(spark, two, inc, now=2)
    index.build(spark, two, full, now=2)

    def rows(folder):
        return sorted(map(tuple, index.Snapshots(spark, folder).read("chunks").select(*cols).collect()))

    assert rows(inc) == rows(full)
    kept = index.Snapshots(spark, inc).read("chunks").where("file_path = 'c.md'").first()
    assert kept.last_indexed == 1
    index.build(spark, two, inc, size=5, overlap=1, now=3)  # another configuration: everything again
    assert {r.last_indexed for r in index.Snapshots(spark, inc).read("chunks").collect()} == {3}
    index.Snapshots(spark, inc).clear()
    assert index.Snapshots(spark, inc).current() is None


def test_scan_and_config(spark, tmp_path):
    (tmp_path / "src" / "dist").mkdir(parents=True)
    (tmp_path / "src" / "distance.rs").write_text("fn a() {}")
    (tmp_path / "src" / "dist" / "x.rs").write_text("no")
    (tmp_path / "src" / "y.min.js").write_text("no")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "z.txt").write_text("no")
    got = {(r.file_path, r.module, r.content) for r in files.scan(spark, str(tmp_path), ["dist", "*.min.js"]).collect()}
    assert got == {("src/distance.rs", "src", "fn a() {}"), ("src/bad.py", "src", None)}
    c = config.load(str(tmp_path / "none.json"))
    config.save(c, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == c


def test_stream_leads_to_the_same_index(spark, tmp_path):
    from delvework.streaming.ingest import watch

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "file_path string, module string, content string"
    spark.createDataFrame([("a.sh", "m", "f() {\n}")], schema).write.mode("append").parquet(src)
    watch(spark, src, out, cp).awaitTermination(120)
    spark.createDataFrame([("b.sh", "m", "g() {\n}")], schema).write.mode("append").parquet(src)
    watch(spark, src, out, cp).awaitTermination(120)
    assert sorted(r.symbol_name for r in index.Snapshots(spark, out).read("chunks").collect()) == ["f", "g"]


def test_removed_and_documents(spark):
    mods = spark.createDataFrame([("a", "partial:1"), ("b", "unknown")], "module_key string, raw_status string")
    kept, archive = modules.removed(mods, ["a"])
    assert sorted(map(tuple, kept.collect())) == [("a", "unknown"), ("b", "unknown")] and [tuple(r) for r in archive.collect()] == [("a", "partial:1")]
    assert [r.module_key for r in modules.removed(mods, ["a"], hard=True)[0].collect()] == ["b"]
    docs = spark.createDataFrame([("a", "modules/a/notes_1.md"), ("a", "modules/a/api.md"), ("b", "modules/b/history.md"), (None, "api.md")], "module string, file_path string")
    assert {r.module_key: r.documents for r in modules.documents(docs).collect()} == {"a": "api, notes", "b": ""}


def test_summary_and_notes(spark):
    from delvework.sources.changes import changed_paths

    paths = spark.createDataFrame([(p,) for p in ("src/main.rs", "src/a.rs", "src/b.rs", "x.py", "dist/c.rs", ".git/d.rs", "a/b/c/d/e.rs", None)], "path string")
    assert tuple(listing.project_summary(paths).first()) == (4, "rs", "src/main.rs")
    assert tuple(listing.project_summary(paths.where("false")).first()) == (0, "", "")
    t = datetime.datetime
    schema = "note_id long, ts timestamp, module string, body string"
    notes = spark.createDataFrame([(1, t(2030, 1, 1), "src/search", "x"), (2, t(2030, 1, 2), None, "about Search"), (3, t(2030, 1, 3), None, "other")], schema)
    more = memory.added(notes, spark.createDataFrame([(3, t(2030, 9, 9), None, "again"), (4, t(2030, 1, 4), "src/search", "new")], schema))
    assert sorted(r.note_id for r in more.collect()) == [1, 2, 3, 4]
    assert sorted(r.note_id for r in memory.for_module(more, "src/search", 3).collect()) == [2, 4]
    assert sorted(r.path for r in changed_paths(paths, paths).collect()) == sorted(r.path for r in paths.where("path IS NOT NULL").collect())
