"""The registered queries of the core operators. Their SQL counterparts are in :mod:`delvework.plans.sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delvework.functions import text as T
from delvework.operators import bm25, chunking, fusion, index, listing, memory, modules, search, vectors
from delvework.plans.sql import NOW, SQL  # noqa: F401  (the driver reads SQL from here)
from delvework.sources import changes, files
from delvework.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _doc_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files."""
    return spread(table(spark, d, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "module", F.col("text").alias("content"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_chunks")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("file_path").alias("path"))


# chunking


@query
def line_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_windows(_doc_files(spark, d), 10, 3).select("id", "start_line", "end_line", F.md5("content").alias("digest"))


@query
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.heading_sections(_doc_files(spark, d)).select("id", "start_line", "end_line", F.col("symbol_name").alias("section"), F.md5("content").alias("digest"))


@query
def regex_boundary_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _code(spark, d).dropDuplicates(["id"])
    # each chunk stands for a file of its own
    own = c.select(F.concat(F.regexp_replace("id", ":", "/"), F.lit("."), T.extension(F.col("file_path"))).alias("file_path"), "module", "content")
    return chunking.boundary_chunks(own, 40).select("id", "start_line", "end_line", "symbol_name", F.md5("content").alias("digest"))


@query
def symbol_split(spark: SparkSession, d: str) -> DataFrame:
    c = _code(spark, d).dropDuplicates(["id"])
    return chunking.split_symbols(c, 25).select("id", "start_line", "end_line", "symbol_name", F.md5("content").alias("digest")).distinct()


@query
def python_syntax_chunks(spark: SparkSession, d: str) -> DataFrame:
    whole = chunking.reassembled(table(spark, d, "chunks").where(chunking.is_python(F.col("file_path"))))
    return chunking.python_chunks(whole, 60, 10).select("id", "start_line", "end_line", "symbol_name")


@query
def syntax_chunks(spark: SparkSession, d: str) -> DataFrame:
    whole = chunking.reassembled(table(spark, d, "chunks").where(chunking.has_syntax(F.col("file_path"))))
    return chunking.syntax_chunks(whole, 60, 10).select("id", "start_line", "end_line", "symbol_name", F.md5("content").alias("digest"))


@query
def all_kinds_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The dispatcher over whole files of every kind, code and documents."""
    both = chunking.reassembled(table(spark, d, "chunks")).unionByName(chunking.reassembled(table(spark, d, "doc_chunks")))
    return chunking.chunk_files(both, 60, 10).select("id", "start_line", "end_line", "symbol_name", F.md5("content").alias("digest"))


@query
def preview_lines(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).where("id IS NOT NULL").select("id", T.preview(F.col("content"), 5).alias("preview")).dropDuplicates(["id"])


# index maintenance


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return index.file_hashes(table(spark, d, "chunks"))


@query
def changed_files_anti(spark: SparkSession, d: str) -> DataFrame:
    now = index.file_hashes(table(spark, d, "chunks")).unionByName(index.file_hashes(table(spark, d, "doc_chunks"), "docs:"))
    return index.changed(now, table(spark, d, "file_hashes"))


@query
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    chunks, touched = table(spark, d, "chunks"), modules.normal_changes(table(spark, d, "changed_paths"))
    changed_files = touched.withColumnRenamed("path", "file_path")
    # what was indexed again: the chunks of changed files, except those with a symbol of their own
    fresh = chunks.join(changed_files, "file_path", "left_semi").where("symbol_name IS NULL").withColumn("last_indexed", F.lit(NOW).cast("long"))
    return index.merged(chunks.select("id", "file_path", "last_indexed"), fresh, touched)


@query
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.stats(table(spark, d, "chunks"))


# query analysis


@query
def cjk_bigrams(spark: SparkSession, d: str) -> DataFrame:
    once = bm25.unique(_docs(spark, d), "content")
    return once.select(F.explode(T.bigrams(F.col("content"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query
def split_query(spark: SparkSession, d: str) -> DataFrame:
    wide, words = T.query_columns(F.col("body"))
    n = table(spark, d, "notes").where("body IS NOT NULL").select("note_id", "body").distinct()
    return n.select("note_id", F.array_join(wide, " ").alias("cjk"), F.array_join(words, " ").alias("words"))


@query
def path_normal(spark: SparkSession, d: str) -> DataFrame:
    return modules.normal_changes(table(spark, d, "changed_paths"))


# keyword search


@query
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text")
    s = bm25.trigram_scored(rows, ["snapshot", "keit"], {"text": 1.0}).where("all_terms")
    return fusion.top(s, 20).select("id", "score", "rank")


@query
def bm25_or(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text")
    return fusion.top(bm25.trigram_scored(rows, ["tion", "schen"], {"text": 1.0}), 50).select("id", "score", "rank")


@query
def bm25_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top(bm25.trigram_scored(_code(spark, d), ["snapshot", "reader"], search.CODE_WEIGHTS), 50).select("id", "score", "rank")


@query
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every matching chunk with its score: no report, the whole result."""
    return bm25.trigram_scored(_code(spark, d), ["budget", "marker"], search.CODE_WEIGHTS).select("id", "score", "all_terms")


@query
def bm25_module_filter(spark: SparkSession, d: str) -> DataFrame:
    s = bm25.trigram_scored(_code(spark, d), ["snapshot", "reader"], search.CODE_WEIGHTS).where("module = 'core'")
    return fusion.top(s, 20).select("id", "score", "rank")


@query
def exact_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_phrase(_code(spark, d), 'older "clients" still', search.CODE_WEIGHTS, 30)


@query
def short_word_like(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword(_code(spark, d), "if in", search.CODE_WEIGHTS, 30)


@query
def and_or_cascade(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword(_code(spark, d), "snapshot zzzqqq", search.CODE_WEIGHTS, 20)


@query
def cjk_search(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword(_docs(spark, d), "版本快照", search.DOC_WEIGHTS, 20)


@query
def mixed_search(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword(_docs(spark, d), "bucket 模块", search.DOC_WEIGHTS, 20)


@query
def doc_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d)
    found = search.search(rows, "retry snapshot", weights=search.DOC_WEIGHTS, limit=15)
    return search.results(found, rows, 6).select("rank", "id", "section", "preview", "score")


# vectors and fusion


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return vectors.nearest(v, v.where("id % 50 = 0"), 10)


@query
def cosine_module_filter(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return vectors.nearest(v.where("label = 2"), v.where("id % 50 = 0"), 5)


def _near(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """The documents nearest to the vector with the least id, as a ranked list.

    The tables have no ids in common: document n has the vector of place n modulo the number of vectors, so all of them
    take part.
    """
    v = _vectors(spark, d)
    one = v.agg(F.min_by("vector", "id")).scalar()
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % v.agg(F.count("*")).scalar()).alias("id"))
    near = v.withColumn("asked", one).select("id", F.round(vectors.cosine(F.col("vector"), F.col("asked")), 6).alias("score"))
    return fusion.top(docs.join(near, "id").select(F.col("doc_id").alias("id"), "score"), limit)


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text")
    a = fusion.top(bm25.trigram_scored(rows, ["report"], {"text": 1.0}), 30)
    b = fusion.top(bm25.trigram_scored(rows, ["folder"], {"text": 1.0}), 30)
    return fusion.fuse([a, b], 20)


def _doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``id, module, vector`` of the document chunks: the tables share no ids, so a hash of a chunk's id picks its vector."""
    v = _vectors(spark, d)
    place = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % v.agg(F.count("*")).scalar()
    once = bm25.unique(_docs(spark, d), "module").select(F.col("id").alias("doc"), "module", place.alias("id"))
    return once.join(v, "id").select(F.col("doc").alias("id"), "module", "vector")


@query
def hybrid_doc_search(spark: SparkSession, d: str) -> DataFrame:
    asked = _vectors(spark, d).agg(F.min_by("vector", "id")).scalar()
    near = vectors.near(_doc_vectors(spark, d), asked, search.fetch_size(20))
    return search.search_docs(_docs(spark, d), "retry snapshot", 20, near=near)


@query
def semantic_module_docs(spark: SparkSession, d: str) -> DataFrame:
    asked = _vectors(spark, d).agg(F.min_by("vector", "id")).scalar()
    rows = _doc_vectors(spark, d)
    return search.search(_docs(spark, d), "", mode="semantic", limit=10, near=vectors.near(rows, asked, 30, module="src/core"))


@query
def one_list_raw(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text")
    found, none = (fusion.top(bm25.trigram_scored(rows, [w], {"text": 1.0}), 30) for w in ("report", "zzzqqq"))
    return fusion.fuse([none, found], 20)


@query
def like_docs(spark: SparkSession, d: str) -> DataFrame:
    return search.like(_docs(spark, d), ["is", "to"], ["content", "section"], 40)


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text", "module")
    return search.search(rows, "report folder", weights={"text": 1.0}, limit=20, near=_near(spark, d, search.fetch_size(20)))


# modules and changes


@query
def status_parse(spark: SparkSession, d: str) -> DataFrame:
    return modules.statuses(table(spark, d, "modules"), NOW)


@query
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return modules.rollup(modules.statuses(table(spark, d, "modules"), NOW))


@query
def status_table(spark: SparkSession, d: str) -> DataFrame:
    return modules.overview(table(spark, d, "modules"), NOW)


@query
def status_set(spark: SparkSession, d: str) -> DataFrame:
    """The modules with the most notes, in the order of their keys, set to outdated."""
    m = table(spark, d, "modules")
    many = table(spark, d, "notes").where("module IS NOT NULL").groupBy("module").agg(F.countDistinct("note_id").alias("n")).where("n >= 3")
    keys = [r.module for r in many.join(m, F.col("module") == F.col("module_key"), "left_semi").collect()]  # no more than there are modules
    return modules.set_status(modules.statuses(m, NOW), keys, "outdated", NOW, "many notes")


@query
def modules_added(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "doc_chunks").where("module IS NOT NULL").select(F.concat("module", F.lit("/handlers")).alias("module_key")).unionByName(table(spark, d, "modules").select("module_key"))
    return modules.added(table(spark, d, "modules"), keys, _paths(spark, d))


@query
def modules_analyzed(spark: SparkSession, d: str) -> DataFrame:
    changed = modules.changes_by_module(table(spark, d, "changed_paths"), table(spark, d, "modules"))
    return modules.analyzed(table(spark, d, "modules"), changed.select("module_key"), NOW)


@query
def doc_keys(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("file_path IS NOT NULL").select("file_path", modules.doc_key(F.col("file_path")).alias("module_key")).distinct()


@query
def excluded_paths(spark: SparkSession, d: str) -> DataFrame:
    hit = files.excluded(F.col("path"), ["third_party", "/vendor/", "*.min.js", "*_test.go"])
    return _paths(spark, d).where("path IS NOT NULL").select("path", hit.alias("excluded"), chunking.indexable(F.col("path")).alias("indexable"), modules.safe_label(F.col("path")).alias("label")).distinct()


@query
def changed_union(spark: SparkSession, d: str) -> DataFrame:
    staged = table(spark, d, "file_hashes").where("sha256 IS NULL OR sha256 = ''").select("path")
    return changes.changed_paths(staged, table(spark, d, "changed_paths"))


@query
def changes_by_module(spark: SparkSession, d: str) -> DataFrame:
    return modules.changes_by_module(table(spark, d, "changed_paths"), table(spark, d, "modules"))


@query
def path_prefix_outdated(spark: SparkSession, d: str) -> DataFrame:
    return modules.outdated(table(spark, d, "changed_paths"), table(spark, d, "modules"), NOW)


@query
def unmatched_changes_anti(spark: SparkSession, d: str) -> DataFrame:
    return modules.unmatched(table(spark, d, "changed_paths"), table(spark, d, "modules"))


@query
def module_load(spark: SparkSession, d: str) -> DataFrame:
    return modules.load(table(spark, d, "modules"), table(spark, d, "notes"), table(spark, d, "doc_chunks"), NOW)


# listings


@query
def extension_counts(spark: SparkSession, d: str) -> DataFrame:
    return listing.extension_counts(_paths(spark, d), 3)


@query
def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    return listing.tree(_paths(spark, d), 2)


@query
def language_threshold(spark: SparkSession, d: str) -> DataFrame:
    return listing.languages(_paths(spark, d), 2)


# notes


@query
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return memory.notes_with_tag(table(spark, d, "notes"), "perf").select("note_id", "module")


@query
def corrections_since(spark: SparkSession, d: str) -> DataFrame:
    return memory.corrections(table(spark, d, "notes"), "2030-04-01", "Search").select("note_id", "module", "ts")


@query
def note_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").where("ts IS NOT NULL").dropDuplicates(["note_id"])
    return n.select("note_id", F.md5(memory.note_block(F.col("ts"), F.col("module"), F.col("body"), F.col("tags"))).alias("digest"))


@query
def newest_notes(spark: SparkSession, d: str) -> DataFrame:
    return memory.newest_headings(table(spark, d, "notes"), 10)


@query
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    return listing.project_summary(_paths(spark, d))


@query
def module_sources(spark: SparkSession, d: str) -> DataFrame:
    return listing.module_sources(_paths(spark, d), table(spark, d, "modules"))


@query
def module_documents(spark: SparkSession, d: str) -> DataFrame:
    return modules.documents(table(spark, d, "doc_chunks"))


@query
def corrections_for_module(spark: SparkSession, d: str) -> DataFrame:
    return memory.for_module(table(spark, d, "notes"), "src/search", 40).select("note_id", "day")
