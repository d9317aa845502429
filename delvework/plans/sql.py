"""What the registered queries mean, in SQL for DuckDB over the same tables."""

from __future__ import annotations

#: The time that stands for "now" in queries, so that results don't depend on when they run.
NOW = 1_910_000_000

_CJK = "[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"

_CODE = "SELECT id, any_value(file_path) AS file_path, any_value(module) AS module, any_value(content) AS content, any_value(symbol_name) AS symbol_name FROM chunks WHERE id IS NOT NULL GROUP BY id"
_DOCS = "SELECT id, any_value(file_path) AS file_path, any_value(module) AS module, any_value(content) AS content, any_value(section) AS section FROM doc_chunks WHERE id IS NOT NULL GROUP BY id"
_TEXTS = "SELECT doc_id AS id, text AS content FROM documents"


def _lines(text: str) -> str:
    """SQL for the lines of a text."""
    parts = rf"string_split(regexp_replace({text}, '\r(\n|$)', '\1', 'g'), chr(10))"
    return f"(CASE WHEN ({parts})[-1] = '' THEN ({parts})[1:-2] ELSE {parts} END)"


def _count(column: str, term: str) -> str:
    """SQL for how often a term that can't overlap itself occurs."""
    low = f"lower(coalesce({column}, ''))"
    return f"((length({low}) - length(replace({low}, '{term}', ''))) // {len(term)})"


def _runs(column: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(coalesce({column}, ''), '{_CJK}+'), lambda r: greatest(length(r) - 1, 1))), 0)"


def _bm25(rows: str, terms: list[str], weights: dict[str, float], where: str = "any_hit", cjk: bool = False) -> str:
    """SQL for ``id, score, all_terms`` by BM25; ``where`` may use any_hit, all_hit and the rows' columns."""
    tf = [" + ".join(f"{w} * {_count(c, t)}" for c, w in weights.items()) for t in terms]
    size = " + ".join(_runs(c) if cjk else f"greatest(length(coalesce({c}, '')) - 2, 0)" for c in weights)
    df = [f"count(*) FILTER (tf{i} > 0)" for i in range(len(terms))]
    idf = [f"CASE WHEN ln((count(*) - {x} + 0.5) / ({x} + 0.5)) <= 0 THEN 1e-6 ELSE ln((count(*) - {x} + 0.5) / ({x} + 0.5)) END AS idf{i}" for i, x in enumerate(df)]
    score = " + ".join(f"idf{i} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * d / avg_d))" for i in range(len(terms)))
    hits = [f"tf{i} > 0" for i in range(len(terms))]
    return f"""SELECT * FROM (SELECT b.*, round({score}, 6) AS score, ({' AND '.join(hits)}) AS all_hit, ({' OR '.join(hits)}) AS any_hit
      FROM (SELECT *, {', '.join(f'CAST({x} AS DOUBLE) AS tf{i}' for i, x in enumerate(tf))}, CAST({size} AS DOUBLE) AS d FROM ({rows})) b,
           (SELECT greatest(avg(d), 1e-9) AS avg_d, {', '.join(idf)} FROM (SELECT {', '.join(f'CAST({x} AS DOUBLE) AS tf{i}' for i, x in enumerate(tf))}, CAST({size} AS DOUBLE) AS d FROM ({rows})))) WHERE {where}"""


def _top(rows: str, limit: int) -> str:
    return f"SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({rows}) ORDER BY score DESC, id LIMIT {limit}"


def _rrf(a: str, b: str, limit: int) -> str:
    fused = f"SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM ({a}) UNION ALL SELECT * FROM ({b})) GROUP BY id"
    return _top(fused, limit)


_CODE_W, _DOC_W = {"content": 1.0, "symbol_name": 10.0}, {"content": 1.0, "section": 5.0}
_EXT = "CASE WHEN regexp_extract({p}, '[^/]\\.([^./]+)$', 1) = '' THEN '~' ELSE lower(regexp_extract({p}, '[^/]\\.([^./]+)$', 1)) END"
_HASHES = """SELECT {p} || file_path AS path, sha256(string_agg(h, ',' ORDER BY a, b, h)) AS sha256 FROM
  (SELECT DISTINCT file_path, coalesce(start_line, 0) AS a, coalesce(end_line, 0) AS b, sha256(coalesce(content, '')) AS h FROM {t} WHERE file_path IS NOT NULL) GROUP BY file_path"""
_CHANGES = r"SELECT DISTINCT regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path FROM changed_paths WHERE path IS NOT NULL AND path <> ''"
_BY_MODULE = f"SELECT DISTINCT module_key, path FROM modules, ({_CHANGES}) c WHERE path = module_key OR starts_with(path, module_key || '/') OR (module_key = '_root_' AND NOT contains(path, '/'))"
_STATUS = rf"""SELECT module_key, state, CASE WHEN state <> 'unknown' THEN coalesce(CASE WHEN regexp_full_match(e, '[+-]?\d{{1,12}}') THEN CAST(e AS BIGINT) END, {NOW}) END AS since,
  CASE WHEN state = 'outdated' THEN coalesce(nullif(regexp_extract(t, '^[^:]*:[^:]*:(.*)$', 1, 's'), ''), '') END AS reason
  FROM (SELECT module_key, t, string_split(t, ':')[2] AS e, CASE WHEN string_split(t, ':')[1] IN ('analyzing', 'partial', 'understood', 'outdated') THEN string_split(t, ':')[1] ELSE 'unknown' END AS state
        FROM (SELECT module_key, regexp_replace(coalesce(raw_status, ''), '^\s+|\s+$', '', 'g') AS t FROM modules))"""
_PATHS = "SELECT DISTINCT file_path AS path FROM chunks WHERE file_path IS NOT NULL"


def _dirs(depth: int) -> str:
    return f"""SELECT path, CASE WHEN i = 0 THEN '.' ELSE array_to_string(p[1:i], '/') END AS directory
      FROM (SELECT path, p, unnest(range(0, least(len(p) - 1, {depth}) + 1)) AS i FROM (SELECT path, string_split(path, '/') AS p FROM ({_PATHS})))"""


_EXTS = f"SELECT directory, {_EXT.format(p='path')} AS extension, count(*) AS files FROM ({{d}}) GROUP BY ALL"
_NEAR = """SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM
  (SELECT doc_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT arg_min(CAST(embedding AS DOUBLE[]), vec_id) FROM embeddings)), 6) AS score
   FROM embeddings JOIN documents ON vec_id = doc_id % (SELECT count(*) FROM embeddings)) ORDER BY score DESC, id LIMIT 60"""


_DOC_NEAR = f"""SELECT id, module, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT arg_min(CAST(embedding AS DOUBLE[]), vec_id) FROM embeddings)), 6) AS score
  FROM ({_DOCS}) JOIN embeddings ON vec_id = CAST('0x' || substring(md5(id), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)"""


def _knn(where: str, k: int) -> str:
    return f"""SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
      (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
       FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND {where})) WHERE rank <= {k}"""


def _boundaries() -> str:
    """SQL for boundary chunks of PHP, Kotlin, Lua and shell chunks taken as files."""
    from delvework.operators.chunking import BOUNDARIES

    parts = []
    for ext in ("php", "kt", "lua", "sh"):
        forms = [f"nullif(regexp_extract(x, '{p}', 1), '')" for p in BOUNDARIES[ext]]
        name = "coalesce(" + ", ".join(forms) + ", '')"
        parts.append(f"SELECT f, ls, i AS line, {name} AS name FROM (SELECT f, ls, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM files WHERE ends_with(f, '.{ext}'))")
    return f"""WITH files AS (SELECT replace(id, ':', '/') || '.' || e AS f, {_lines('content')} AS ls FROM (SELECT id, any_value(content) AS content, {_EXT.format(p='any_value(file_path)')} AS e FROM chunks GROUP BY id)),
      cut AS (SELECT f, ls, name, line AS a, coalesce(lead(line) OVER (PARTITION BY f ORDER BY line) - 1, len(ls)) AS b FROM ({' UNION ALL '.join(parts)}) WHERE name <> ''),
      piece AS (SELECT f, ls, name, a, b, unnest(range(0, (b - a) // 40 + 1)) AS o FROM cut),
      r AS (SELECT f, name, o, a + o * 40 AS s, least(a + o * 40 + 39, b) AS e, ls FROM piece)
      SELECT f || ':' || s || '-' || e AS id, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, CASE WHEN o = 0 THEN name ELSE name || '(cont.)' END AS symbol_name, md5(array_to_string(ls[s:e], chr(10))) AS digest
      FROM r WHERE regexp_replace(array_to_string(ls[s:e], chr(10)), '\\s', '', 'g') <> ''"""


_SOURCES = "'rs', 'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'vue', 'svelte', 'py', 'pyi', 'go', 'java', 'kt', 'kts', 'swift', 'cpp', 'cc', 'cxx', 'c', 'h', 'hpp', 'cs', 'rb', 'php', 'scala', 'lua', 'sh', 'bash'"
_INDEXABLE = _SOURCES + ", 'hxx', 'hh', 'sc', 'zsh', 'hs', 'lhs', 'md'"

SQL: dict[str, str] = {
    "line_window_chunks": f"""WITH f AS (SELECT 'doc/' || doc_id AS p, {_lines('text')} AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
      w AS (SELECT p, ls, unnest(range(0, greatest(CAST(ceil((len(ls) - 10) / 7.0) AS BIGINT), 0) + 1)) AS k FROM f WHERE len(ls) > 0),
      r AS (SELECT p, ls, k * 7 + 1 AS s, least(k * 7 + 10, len(ls)) AS e FROM w)
      SELECT p || ':' || s || '-' || e AS id, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, md5(array_to_string(ls[s:e], chr(10))) AS digest
      FROM r WHERE regexp_replace(array_to_string(ls[s:e], chr(10)), '\\s', '', 'g') <> ''""",
    "heading_chunks": f"""WITH f AS (SELECT 'doc/' || doc_id AS p, text, {_lines('text')} AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
      l AS (SELECT p, ls, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM f),
      h AS (SELECT p, ls, i, regexp_replace(regexp_replace(x, '^#+', ''), '^\\s+|\\s+$', '', 'g') AS title FROM l WHERE starts_with(x, '#')),
      c AS (SELECT p, ls, title, i AS s, coalesce(lead(i) OVER (PARTITION BY p ORDER BY i) - 1, len(ls)) AS e FROM h WHERE title <> ''),
      r AS (SELECT p, title, s, e, array_to_string(ls[s:e], chr(10)) AS body FROM c
            UNION ALL SELECT p, NULL, 1, len(ls), regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM f WHERE p NOT IN (SELECT p FROM c))
      SELECT p || ':' || s || '-' || e AS id, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, title AS section, md5(body) AS digest FROM r WHERE regexp_replace(body, '\\s', '', 'g') <> ''""",
    "regex_boundary_chunks": _boundaries(),
    "symbol_split": f"""WITH f AS (SELECT id, any_value(file_path) AS p, any_value(symbol_name) AS n, coalesce(any_value(start_line), 1) AS a, {_lines('any_value(content)')} AS ls FROM chunks GROUP BY id),
      w AS (SELECT p, n, a, ls, unnest(range(0, (len(ls) - 1) // 25 + 1)) * 25 AS o FROM f WHERE n IS NOT NULL AND n NOT IN ('<var>', '<unknown>') AND p IS NOT NULL AND len(ls) > 0),
      r AS (SELECT p, n, o, a + o AS s, a + least(o + 25, len(ls)) - 1 AS e, array_to_string(ls[o + 1:least(o + 25, len(ls))], chr(10)) AS body FROM w)
      SELECT DISTINCT p || ':' || s || '-' || e AS id, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, CASE WHEN o = 0 THEN n ELSE n || '(cont.+' || o || ')' END AS symbol_name, md5(body) AS digest
      FROM r WHERE regexp_replace(body, '\\s', '', 'g') <> ''""",
    "preview_lines": f"SELECT id, array_to_string(({_lines('content')})[1:5], chr(10)) AS preview FROM ({_CODE})",
    "content_hash": _HASHES.format(p="''", t="chunks"),
    "changed_files_anti": f"""WITH c AS ({_HASHES.format(p="''", t="chunks")} UNION ALL {_HASHES.format(p="'docs:'", t="doc_chunks")}),
      s AS (SELECT path, min(coalesce(sha256, '')) AS old, max(coalesce(sha256, '')) AS old2 FROM file_hashes WHERE path IS NOT NULL GROUP BY path)
      SELECT * FROM (SELECT coalesce(c.path, s.path) AS path, CASE WHEN old IS NULL THEN 'new' WHEN sha256 IS NULL THEN 'gone' WHEN old <> sha256 OR old2 <> sha256 THEN 'changed' END AS change
      FROM c FULL JOIN s ON c.path = s.path) WHERE change IS NOT NULL""",
    "incremental_merge": f"""SELECT id, any_value(file_path) AS file_path, max(last_indexed) AS last_indexed FROM (
      SELECT id, file_path, last_indexed FROM chunks WHERE file_path IS NULL OR file_path NOT IN ({_CHANGES})
      UNION ALL SELECT id, file_path, {NOW} FROM chunks WHERE file_path IN ({_CHANGES}) AND symbol_name IS NULL) GROUP BY id""",
    "index_stats": "SELECT count(DISTINCT id) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT nullif(module, '')) AS modules, max(last_indexed) AS last_indexed FROM chunks",
    "cjk_bigrams": f"""WITH r AS (SELECT unnest(regexp_extract_all(content, '{_CJK}+')) AS r FROM ({_DOCS}))
      SELECT bigram, count(*) AS n FROM (SELECT CASE WHEN length(r) = 1 THEN r ELSE substring(r, i, 2) END AS bigram FROM (SELECT r, unnest(range(1, greatest(length(r), 2))) AS i FROM r)) GROUP BY bigram""",
    "split_query": f"""SELECT note_id, array_to_string(regexp_extract_all(body, '{_CJK}+'), ' ') AS cjk,
      array_to_string(list_filter(list_transform(regexp_extract_all(body, '[^\\s{_CJK[1:-1]}]+'), lambda r: regexp_replace(r, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda r: r <> ''), ' ') AS words
      FROM (SELECT DISTINCT note_id, body FROM notes WHERE body IS NOT NULL)""",
    "path_normal": _CHANGES,
    "bm25_and": _top(_bm25(_TEXTS, ["snapshot", "keit"], {"content": 1.0}, "all_hit"), 20),
    "bm25_or": _top(_bm25(_TEXTS, ["tion", "schen"], {"content": 1.0}), 50),
    "bm25_weighted": _top(_bm25(_CODE, ["snapshot", "reader"], _CODE_W), 50),
    "bm25_scores": f"SELECT id, score, all_hit AS all_terms FROM ({_bm25(_CODE, ['budget', 'marker'], _CODE_W)})",
    "bm25_module_filter": _top(_bm25(_CODE, ["snapshot", "reader"], _CODE_W, "any_hit AND module = 'core'"), 20),
    "exact_phrase": _top(_bm25(_CODE, ["older clients still"], _CODE_W), 30),
    "short_word_like": _top(f"SELECT id, 1.0::DOUBLE AS score FROM ({_CODE}) WHERE (contains(lower(content), 'if') OR contains(lower(coalesce(symbol_name, '')), 'if')) AND (contains(lower(content), 'in') OR contains(lower(coalesce(symbol_name, '')), 'in'))", 30),
    "and_or_cascade": _top(_bm25(_CODE, ["snapshot", "zzzqqq"], _CODE_W), 20),
    "cjk_search": f"WITH s AS ({_bm25(_DOCS, ['版本', '本快', '快照'], _DOC_W, cjk=True)}) {_top('SELECT id, score FROM s WHERE all_hit OR NOT (SELECT bool_or(all_hit) FROM s)', 20)}",
    "mixed_search": f"WITH a AS ({_bm25(_DOCS, ['模块'], _DOC_W, cjk=True)}), b AS ({_bm25(_DOCS, ['bucket'], _DOC_W)}) " + _rrf(_top("SELECT id, score FROM a", 60), _top("SELECT id, score FROM b", 60), 20),
    "doc_search": f"""WITH s AS ({_bm25(_DOCS, ['retry', 'snapshot'], _DOC_W)}),
      t AS ({_top('SELECT id, score FROM s WHERE all_hit OR NOT (SELECT bool_or(all_hit) FROM s)', 15)})
      SELECT rank, id, section, array_to_string(({_lines('content')})[1:6], chr(10)) AS preview, score FROM t JOIN ({_DOCS}) USING (id)""",
    "cosine_topk": _knn("true", 10),
    "cosine_module_filter": _knn("c.label = 2", 5),
    "rrf_fusion": _rrf(_top(_bm25(_TEXTS, ["report"], {"content": 1.0}), 30), _top(_bm25(_TEXTS, ["folder"], {"content": 1.0}), 30), 20),
    "hybrid_search": f"WITH s AS ({_bm25(_TEXTS, ['report', 'folder'], {'content': 1.0})}) " + _rrf(_NEAR, _top("SELECT id, score FROM s WHERE all_hit OR NOT (SELECT bool_or(all_hit) FROM s)", 60), 20),
    "hybrid_doc_search": f"WITH s AS ({_bm25(_DOCS, ['retry', 'snapshot'], _DOC_W)}) " + _rrf(_top(f"SELECT id, score FROM ({_DOC_NEAR})", 60), _top("SELECT id, score FROM s WHERE all_hit OR NOT (SELECT bool_or(all_hit) FROM s)", 60), 20),
    "semantic_module_docs": _top(f"SELECT id, score FROM ({_DOC_NEAR}) WHERE module = 'src/core'", 10),
    "one_list_raw": _top(_bm25(_TEXTS, ["report"], {"content": 1.0}), 20),
    "like_docs": _top(f"SELECT id, 1.0::DOUBLE AS score FROM ({_DOCS}) WHERE (contains(lower(content), 'is') OR contains(lower(coalesce(section, '')), 'is')) AND (contains(lower(content), 'to') OR contains(lower(coalesce(section, '')), 'to'))", 40),
    "status_table": f"SELECT *, (SELECT count(*) FROM ({_STATUS}) WHERE state = 'outdated') AS outdated FROM ({_STATUS})",
    "status_set": f"""WITH k AS (SELECT module FROM notes WHERE module IS NOT NULL GROUP BY module HAVING count(DISTINCT note_id) >= 3)
      SELECT module_key, CASE WHEN k.module IS NULL THEN state ELSE 'outdated' END AS state, CASE WHEN k.module IS NULL THEN since ELSE {NOW} END AS since, CASE WHEN k.module IS NULL THEN reason ELSE 'many notes' END AS reason
      FROM ({_STATUS}) LEFT JOIN k ON module = module_key""",
    "modules_added": f"""SELECT module_key, raw_status FROM modules UNION ALL
      SELECT k, 'unknown' FROM (SELECT DISTINCT module || '/handlers' AS k FROM doc_chunks WHERE module IS NOT NULL) WHERE k NOT IN (SELECT module_key FROM modules) AND EXISTS (SELECT 1 FROM ({_PATHS}) WHERE path = k OR starts_with(path, k || '/'))""",
    "modules_analyzed": f"""SELECT module_key, CASE WHEN state <> 'understood' AND module_key IN (SELECT module_key FROM ({_BY_MODULE})) THEN 'analyzing:{NOW}' ELSE raw_status END AS raw_status FROM modules JOIN ({_STATUS}) USING (module_key)""",
    "doc_keys": r"""SELECT DISTINCT file_path, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE regexp_replace(p, '(\.md)+$', '') END AS module_key FROM (SELECT file_path, regexp_replace(file_path, '^modules/', '') AS p FROM doc_chunks WHERE file_path IS NOT NULL)""",
    "excluded_paths": f"""SELECT path, len(list_intersect(string_split(path, '/'), ['third_party', 'vendor'])) > 0 OR ends_with(path, '.min.js') OR ends_with(path, '_test.go') AS excluded,
      {_EXT.format(p='path')} IN ({_INDEXABLE}) AS indexable, replace(path, '/', '_') AS label FROM ({_PATHS})""",
    "changed_union": "SELECT path FROM file_hashes WHERE coalesce(sha256, '') = '' AND path IS NOT NULL UNION SELECT path FROM changed_paths WHERE path IS NOT NULL",
    "status_parse": _STATUS,
    "status_rollup": f"SELECT state, coalesce(n, 0) AS n FROM (SELECT unnest(['unknown', 'analyzing', 'partial', 'understood', 'outdated']) AS state) LEFT JOIN (SELECT state, count(*) AS n FROM ({_STATUS}) GROUP BY state) USING (state)",
    "changes_by_module": _BY_MODULE,
    "path_prefix_outdated": f"""SELECT module_key, state, files, names, CASE WHEN state IN ('understood', 'partial') THEN 'outdated:{NOW}:' || files || ' file(s) changed: ' || names END AS new_status FROM
      (SELECT module_key, count(*) AS files, array_to_string((list(string_split(path, '/')[-1] ORDER BY path))[1:3], ', ') AS names FROM ({_BY_MODULE}) GROUP BY module_key) JOIN ({_STATUS}) USING (module_key)""",
    "unmatched_changes_anti": f"SELECT path FROM ({_CHANGES}) WHERE path NOT IN (SELECT path FROM ({_BY_MODULE}))",
    "module_load": f"""SELECT module_key, state, coalesce(n.notes, 0) AS notes, last_note, coalesce(d.docs, 0) AS docs FROM ({_STATUS}) s
      LEFT JOIN (SELECT module AS k, count(DISTINCT note_id) AS notes, max(ts) AS last_note FROM notes WHERE module IS NOT NULL GROUP BY module) n ON n.k = module_key
      LEFT JOIN (SELECT module AS k, count(DISTINCT file_path) AS docs FROM doc_chunks WHERE module IS NOT NULL GROUP BY module) d ON d.k = module_key""",
    "extension_counts": _EXTS.format(d=_dirs(3)),
    "directory_tree": f"SELECT directory, CAST(CASE WHEN directory = '.' THEN 0 ELSE len(string_split(directory, '/')) END AS INTEGER) AS level, CAST(sum(files) AS BIGINT) AS files, string_agg(extension || ':' || files, ' ' ORDER BY extension || ':' || files) AS extensions FROM ({_EXTS.format(d=_dirs(2))}) GROUP BY directory",
    "language_threshold": f"SELECT * FROM (SELECT {_EXT.format(p='path')} AS extension, count(*) AS files FROM ({_PATHS}) GROUP BY 1) WHERE files > 2 AND extension <> '~'",
    "tag_filter": "SELECT note_id, any_value(module) AS module FROM notes WHERE len(list_filter(coalesce(tags, []), lambda t: starts_with(coalesce(t, ''), 'perf'))) > 0 GROUP BY note_id",
    "corrections_since": "SELECT note_id, any_value(module) AS module, any_value(ts) AS ts FROM notes WHERE CAST(ts AS DATE) >= DATE '2030-04-01' AND (contains(lower(coalesce(module, '')), 'search') OR contains(lower(coalesce(body, '')), 'search')) GROUP BY note_id",
    "note_blocks": """SELECT note_id, md5(any_value('## [' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC]' || CASE WHEN module IS NULL THEN '' ELSE '  Module: ' || module END || chr(10) || chr(10) || coalesce(body, '')
      || CASE WHEN len(coalesce(tags, [])) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(tags, lambda t: '#' || t), ' ') ELSE '' END)) AS digest FROM notes WHERE ts IS NOT NULL GROUP BY note_id""",
    "newest_notes": "SELECT CAST(row_number() OVER (ORDER BY ts DESC, note_id) AS INTEGER) AS rank, note_id AS id, string_split(body, chr(10))[1] AS heading FROM (SELECT note_id, any_value(ts) AS ts, any_value(body) AS body FROM notes WHERE module IS NULL AND ts IS NOT NULL GROUP BY note_id) ORDER BY ts DESC, note_id LIMIT 10",
    "project_summary": f"""WITH p AS (SELECT path, string_split(path, '/') AS parts FROM ({_PATHS})),
      k AS (SELECT path, {_EXT.format(p='path')} AS e FROM p WHERE len(parts) <= 4 AND len(list_filter(parts, lambda x: starts_with(x, '.') OR x IN ('node_modules', 'target', 'dist', 'build', 'vendor'))) = 0),
      e AS (SELECT e, count(*) AS n FROM k GROUP BY e)
      SELECT CAST((SELECT count(*) FROM k) AS BIGINT) AS files, coalesce((SELECT string_agg(e, ', ' ORDER BY e) FROM e WHERE n > 2 AND e <> '~'), '') AS languages,
      coalesce((SELECT string_agg(path, ', ' ORDER BY path) FROM k WHERE string_split(path, '/')[-1] IN ('main.rs', 'lib.rs', 'index.ts', 'index.js', 'main.py', 'app.py', 'main.go', 'App.vue', 'App.tsx', 'server.ts', 'server.js', 'main.kt', 'Main.java', 'vite.config.ts', 'vite.config.js')), '') AS entries""",
    "module_sources": f"SELECT module_key, path FROM modules, (SELECT path, {_EXT.format(p='path')} AS e FROM ({_PATHS})) WHERE e IN ({_SOURCES}) AND (path = module_key OR starts_with(path, module_key || '/') OR (module_key = '_root_' AND NOT contains(path, '/')))",
    "module_documents": """SELECT module AS module_key, array_to_string(list_filter(['api', 'internals', 'notes'], lambda d: list_contains(k, d)), ', ') AS documents FROM
      (SELECT module, list(DISTINCT regexp_extract(file_path, '(?:^|/)(api|internals|notes)[^/]*\\.md$', 1)) AS k FROM doc_chunks WHERE module IS NOT NULL AND file_path IS NOT NULL GROUP BY module)""",
    "corrections_for_module": """WITH n AS (SELECT note_id, any_value(CAST(ts AS DATE)) AS day, lower(concat_ws(chr(10), any_value(module), any_value(body))) AS t FROM notes WHERE ts IS NOT NULL GROUP BY note_id)
      SELECT note_id, day FROM n WHERE (contains(t, 'src/search') OR contains(t, 'search')) AND day IN (SELECT DISTINCT day FROM n ORDER BY day DESC LIMIT 40)""",
}
