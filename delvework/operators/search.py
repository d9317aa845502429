"""Search over chunks: exact phrase, keyword cascade, substring fallback, hybrid, and the router between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.functions import text as T
from delvework.operators import bm25, fusion

CODE_WEIGHTS = {"content": 1.0, "symbol_name": 10.0}
DOC_WEIGHTS = {"content": 1.0, "section": 5.0}


def fetch_size(limit: int) -> int:
    """How many rows each list contributes to a fusion."""
    return max(3 * limit, 30)


def _cascade(scored: DataFrame, module: str | None) -> DataFrame:
    """Rows with all terms, or those with any where no row has all, within a module."""
    if module is not None:
        scored = scored.where(F.col("module") == module)
    strict = F.coalesce(scored.agg(F.max("all_terms")).scalar(), F.lit(False))
    return scored.where(F.col("all_terms") | ~strict)


def exact_phrase(rows: DataFrame, phrase: str, weights: dict[str, float], limit: int, module: str | None = None) -> DataFrame:
    """``id, score, rank`` of the rows that hold a phrase of at least three characters, quotes in it dropped."""
    phrase = phrase.replace('"', "")
    scored = bm25.trigram_scored(rows, [phrase], weights)
    return fusion.top(scored.where(F.col("module") == module) if module is not None else scored, limit).select("id", "score", "rank")


def like(rows: DataFrame, words: list[str], columns: list[str], limit: int, module: str | None = None) -> DataFrame:
    """``id, score, rank`` of the rows that hold every word in one of the columns; all score 1."""
    for w in words:
        hit = F.lit(False)
        for c in columns:
            hit = hit | T.contains(F.col(c), w)
        rows = rows.where(hit)
    if module is not None:
        rows = rows.where(F.col("module") == module)
    return fusion.top(rows.where("id IS NOT NULL").select("id", F.lit(1.0).alias("score")).distinct(), limit)


def keyword(rows: DataFrame, query: str, weights: dict[str, float], limit: int, module: str | None = None) -> DataFrame:
    """``id, score, rank`` by keywords: a list for CJK bigrams and one for other words, fused.

    Each list takes rows with all terms, else with any. Words of fewer than three characters only count where all
    words are that short; then rows must hold each of them somewhere.
    """
    wide, words = T.split_query(query)
    fetch, lists = fetch_size(limit), []
    if grams := list(dict.fromkeys(T.query_bigrams(wide))):
        lists.append(fusion.top(_cascade(bm25.bigram_scored(rows, grams, weights), module), fetch))
    if words := list(dict.fromkeys(words)):
        if all(len(w) < 3 for w in words):
            lists.append(like(rows, words, list(weights), fetch, module))
        else:
            lists.append(fusion.top(_cascade(bm25.trigram_scored(rows, words, weights), module), fetch))
    if not lists:
        return rows.where(F.lit(False)).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if len(lists) == 1:
        return fusion.top(lists[0].select("id", "score"), limit)
    return fusion.fuse(lists, limit)


def hybrid(rows: DataFrame, query: str, near: DataFrame, weights: dict[str, float], limit: int, module: str | None = None) -> DataFrame:
    """``id, score, rank``: keyword list and vector list fused; an empty list leaves the other as it is.

    ``near`` is a vector list ``id, score, rank`` of at least :func:`fetch_size` rows; ids that ``rows`` lacks drop out.
    """
    by_word = keyword(rows, query, weights, fetch_size(limit), module)
    return fusion.fuse([near, by_word], limit)


def search(
    rows: DataFrame, query: str, mode: str = "auto", exact: bool = False, limit: int = 10, module: str | None = None, weights: dict[str, float] | None = None, near: DataFrame | None = None
) -> DataFrame:
    """The router: exact phrases first; hybrid where a vector list is given and the mode isn't ``keyword``; else keywords.

    ``mode='semantic'`` needs a vector list and returns it alone.
    """
    weights = weights or CODE_WEIGHTS
    if exact:
        return exact_phrase(rows, query, weights, limit, module)
    if mode == "semantic":
        if near is None:
            raise ValueError("semantic search needs a vector list")
        return fusion.top(near.select("id", "score"), limit)
    if near is not None and mode != "keyword":
        return hybrid(rows, query, near, weights, limit, module)
    return keyword(rows, query, weights, limit, module)


def search_docs(rows: DataFrame, query: str, limit: int = 10, module: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """The router for documents: hybrid where a vector list is given, else keywords; there are no exact phrases or modes."""
    return search(rows, query, limit=limit, module=module, weights=DOC_WEIGHTS, near=near)


def results(found: DataFrame, rows: DataFrame, preview_lines: int = 5) -> DataFrame:
    """Found ids with path, module, lines, symbol or section, and a preview; one join, ranks kept.

    ``found`` is a ranked list, so it has no more rows than were asked for and can be sent to every executor.
    """
    label = "symbol_name" if "symbol_name" in rows.columns else "section"
    shown = F.broadcast(found).join(rows, "id").dropDuplicates(["id"])
    return shown.select("rank", "id", "file_path", "module", "start_line", "end_line", label, T.preview(F.col("content"), preview_lines).alias("preview"), "score")
