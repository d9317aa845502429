"""Text functions of search, as column expressions: CJK bigrams, query analysis, occurrences, previews."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points taken as CJK (fixed values): kana, both blocks of ideographs, hangul, compatibility ideographs.
CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"


def lines(text: Column) -> Column:
    """Lines of a text: split at line feeds, a carriage return before one dropped, no empty last line."""
    body = F.regexp_replace(F.regexp_replace(text, "\r(?=\n|$)", ""), "\n\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def bigrams(text: Column) -> Column:
    """CJK bigrams of a text, in order; a CJK character that stands alone is kept as it is."""
    pair = f"(?=([{CJK}]{{2}}))|(?<![{CJK}])([{CJK}])(?![{CJK}])"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pair), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pair), F.lit(2)).alias("b"))
    return F.transform(both, lambda z: F.concat(z["a"], z["b"]))


def bigram_count(text: Column) -> Column:
    """Number of CJK bigrams of a text."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{CJK}]+"), F.lit(0))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.greatest(F.length(r) - 1, F.lit(1)))


def trigram_count(text: Column) -> Column:
    """Number of character trigrams of a text."""
    return F.greatest(F.length(F.coalesce(text, F.lit(""))) - 2, F.lit(0)).cast("long")


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs in a text, overlaps counted, whatever the case."""
    low, text = term.lower(), F.lower(F.coalesce(text, F.lit("")))
    if any(low.startswith(low[k:]) for k in range(1, len(low))):  # only such a term can overlap itself
        return F.regexp_count(text, F.lit(f"(?={re.escape(low)})")).cast("long")
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(low), F.lit("")))) / len(low)).cast("long")


def contains(text: Column, term: str) -> Column:
    """Whether a text contains a term, whatever the case; null text doesn't."""
    return F.coalesce(F.contains(F.lower(text), F.lit(term.lower())), F.lit(False))


def preview(text: Column, n: int = 5) -> Column:
    """The first ``n`` lines of a text."""
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def split_query(query: str) -> tuple[list[str], list[str]]:
    """(CJK segments, other words) of a query; of other words only letters, digits and underscores are kept."""
    wide, words = [], []
    for part in query.split():
        for run in re.findall(f"[{CJK}]+|[^{CJK}]+", part):
            if re.match(f"[{CJK}]", run):
                wide.append(run)
            elif clean := "".join(c for c in run if c.isalnum() or c == "_"):
                words.append(clean)
    return wide, words


def query_bigrams(segments: list[str]) -> list[str]:
    """Bigrams of CJK query segments; a single character stays."""
    return [g for s in segments for g in ([s] if len(s) == 1 else [s[i : i + 2] for i in range(len(s) - 1)])]


def query_columns(text: Column) -> tuple[Column, Column]:
    """(CJK segments, other words) of query texts, for whole columns of them."""
    wide = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(f"[^\\s{CJK}]+"), F.lit(0))
    words = F.filter(F.transform(runs, lambda r: F.regexp_replace(r, r"[^\p{L}\p{N}_]", "")), lambda r: r != "")
    return wide, words


def normal_path(path: Column) -> Column:
    """A path with forward slashes and without leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def relative_path(path: Column, root: str) -> Column:
    """A path as :func:`normal_path` has it, relative to ``root`` where it is absolute and lies below."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return normal_path(F.when(F.startswith(slashed, F.lit(base)), F.substring(slashed, len(base) + 1, 1 << 30)).otherwise(slashed))


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last component; ``~`` where there is none."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(ext == "", "~").otherwise(ext)
