"""The registered queries in SQL for DuckDB. `//` isn't used; lambdas are written `lambda x: ...`."""

from __future__ import annotations

from siftstone.queries import CODE, FILES, LINES, OVERLAP, WINDOW, WORDS, chunk_sql

# The fixed values are stated here once more, and not taken from the code that the SQL is held against.

#: Definition patterns behind a line's white space, and their kinds.
PATTERNS = [
    (r"class\s+([A-Za-z_][A-Za-z0-9_]*)", "class"),
    (r"def\s+([A-Za-z_][A-Za-z0-9_]*)", "function"),
    (r"(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)", "function"),
    (r"(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)", "class"),
    (r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][A-Za-z0-9_$]*)\s*=>", "function"),
    (r"func\s+([A-Za-z_][A-Za-z0-9_]*)", "function"),
    (r"(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)", "function"),
]
#: Names that are skipped.
SKIPPED_DIRS = [
    ".git", ".hg", ".svn", ".venv", "venv", ".cache", ".gradle", ".turbo", "node_modules", "vendor", "__pycache__", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", ".tox", ".idea", ".next", ".nuxt", "dist", "build", "target", "coverage",
]
SKIPPED_NAMES = [
    ".netrc", ".pgpass", ".htpasswd", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".env", ".envrc", "uv.lock", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "composer.lock", "go.sum",
]
SKIPPED_PREFIX = ".env."
SKIPPED_ENDINGS = [".pem", ".key", ".p12", ".pfx", ".der", ".jks", ".keystore", ".ppk"]
#: Parser language by suffix.
PARSER_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".cs": "c_sharp", ".kt": "kotlin", ".swift": "swift",
}
#: The words of the full-text queries as phrases and as tokens, and those of the path and symbol query.
PHRASES = [["the"], ["license"], ["version"], ["of"], ["nothing", "en"], ["nation"]]
WORD_TOKENS = ["the", "license", "version", "of", "nothing.en", "nation"]
PART_TOKENS = ["part_1", "load_china"]

assert WINDOW > OVERLAP
DOC_CHUNKS, CODE_CHUNKS = chunk_sql(FILES), chunk_sql(CODE)
LANGUAGE = "regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]+)$', 1)"
TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- symbols ---------------------------------------------------------------------------------------------------------

_hits = " UNION ALL ".join(f"SELECT repo, path, {i} AS rank, regexp_extract(line_text, '^\\s*{p.replace(chr(39), chr(39) * 2)}', 1) AS symbol, '{kind}' AS kind, line FROM lines" for i, (p, kind) in enumerate(PATTERNS))
SYMBOLS = f"""(WITH lines AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line_text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {CODE} c),
  hits AS ({_hits})
  SELECT repo, path, symbol, arg_min(kind, rank * 1000000 + line) AS kind, CAST(arg_min(line, rank * 1000000 + line) AS INT) AS line FROM hits WHERE symbol <> '' GROUP BY 1, 2, 3)"""
PLACED = f"""(SELECT s.repo, s.path, s.symbol, s.kind, s.line, arg_min(c.chunk_id, (CASE WHEN s.line BETWEEN c.start_line AND c.end_line THEN 0 ELSE 1000000 END) + c.start_line) AS chunk_id
  FROM {SYMBOLS} s LEFT JOIN {CODE_CHUNKS} c ON s.repo = c.repo AND s.path = c.path GROUP BY ALL)"""

# --- full text -------------------------------------------------------------------------------------------------------

DOC_TOKENS = f"SELECT chunk_id, repo, path, start_line, {TOKENS.format('path')} AS p, {TOKENS.format('content')} AS t FROM {DOC_CHUNKS} c"


def occurrences(tokens: str, phrase: list[str]) -> str:
    """How often a phrase stands in a list of tokens."""
    test = " AND ".join(f"{tokens}[i + {k}] = '{w}'" if k else f"{tokens}[i] = '{w}'" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda i: coalesce({test}, false)))"


_f = ", ".join(f"{occurrences('p', ph)} + {occurrences('t', ph)} AS f{n}" for n, ph in enumerate(PHRASES))
_df = ", ".join(f"count(*) FILTER (f{n} > 0) AS n{n}" for n in range(len(PHRASES)))
_idf = ", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END AS w{i}" for i in range(len(PHRASES)))
_sum = " + ".join(f"w{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(PHRASES)))
_any = " + ".join(f"f{i}" for i in range(len(PHRASES)))
BM25 = f"""(WITH toks AS ({DOC_TOKENS}), fs AS (SELECT chunk_id, repo, path, start_line, CAST(len(p) + len(t) AS DOUBLE) AS dl, {_f} FROM toks),
  df AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {_df} FROM fs), w AS (SELECT avgdl, {_idf} FROM df)
  SELECT chunk_id, repo, path, start_line, round(-({_sum}), 6) AS bm25 FROM fs, w WHERE {_any} > 0)"""
RANKED = f"(SELECT *, row_number() OVER (ORDER BY bm25, repo, path, start_line, chunk_id) - 1 AS rank FROM {BM25} b QUALIFY rank < 100)"

# --- vectors and fusion ----------------------------------------------------------------------------------------------

Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
VECTORS = f"(SELECT c.*, e.embedding FROM {DOC_CHUNKS} c LEFT JOIN embeddings e ON e.vec_id = CAST(regexp_extract(c.path, '/([0-9]+)\\.[a-z]+$', 1) AS BIGINT))"


def path_score(query: str, tokens: list[str], path: str = "path") -> str:
    weak = " OR ".join(f"contains(lower({path}), '{t}')" for t in tokens)
    q = query.lower().strip()
    return f"CASE WHEN contains(lower({path}), '{q}') OR contains('{q}', lower({path})) THEN CAST(4.5 AS DOUBLE) WHEN {weak} THEN 1.5 ELSE 0.0 END"


_path = path_score(WORDS, WORD_TOKENS)
FUSED = f"""(WITH sig AS (
    SELECT chunk_id, 0 AS signal, greatest(0.2, CAST(4.0 AS DOUBLE) - 0.03 * rank) AS score, CAST(NULL AS DOUBLE) AS similarity FROM {RANKED} r
    UNION ALL SELECT chunk_id, 1, 3.0 * s, s FROM (SELECT chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) AS s FROM {VECTORS} v WHERE embedding IS NOT NULL) WHERE s > 0
    UNION ALL SELECT chunk_id, 2, {_path}, NULL FROM {DOC_CHUNKS} c WHERE {_path} > 0)
  SELECT f.*, c.repo, c.path, c.start_line FROM (SELECT chunk_id, round(sum(score), 4) AS score, max(similarity) AS similarity,
    array_to_string(list_transform(list_sort(list(DISTINCT signal)), lambda i: ['bm25', 'vector', 'path', 'symbol'][i + 1]), '+') AS reasons FROM sig GROUP BY 1) f JOIN {DOC_CHUNKS} c USING (chunk_id))"""

# --- snapshots -------------------------------------------------------------------------------------------------------

PRESENT = f"(SELECT repo, CASE WHEN doc_id % 7 = 0 THEN path || '.new' ELSE path END AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN content || '!' ELSE content END) AS h, strlen(content) AS size, doc_id % 13 <> 0 AS readable FROM {FILES} f)"
STORED = f"(SELECT repo, CASE WHEN doc_id % 11 = 0 THEN path || '.old' ELSE path END AS path, sha256(content) AS h FROM {FILES} f)"
SPACES = "\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_names = [*sorted(SKIPPED_DIRS), *sorted(SKIPPED_NAMES), *(f"x{e}" for e in SKIPPED_ENDINGS), ".env.local", "main.py", "env", "keys.txt"]
_endings = " OR ".join(f"ends_with(name, '{e}')" for e in SKIPPED_ENDINGS)
_part = path_score("part_1 load_china", PART_TOKENS)
_symbol = " OR ".join(f"contains(st, '{t}')" for t in PART_TOKENS)

ORACLES = {
    "list_files_glob_lang": f"SELECT repo, path, language, sha256(content) AS file_hash, strlen(content) AS size FROM {FILES} f WHERE path GLOB 'src1*/??/*[0-4].*' AND lower({LANGUAGE}) = 'en' ORDER BY repo, path LIMIT 200",
    "list_languages": f"SELECT DISTINCT lower(language) AS language FROM (SELECT language FROM {FILES} f UNION ALL SELECT {LANGUAGE} FROM {CODE} c) WHERE language <> ''",
    "list_kinds": f"SELECT DISTINCT kind FROM {SYMBOLS} s",
    "repo_summaries": f"""SELECT r.name, coalesce(f.n, 0) AS files, coalesce(c.n, 0) AS chunks, coalesce(c.e, 0) AS embedded_chunks FROM (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT n_name FROM nation) r
      LEFT JOIN (SELECT repo, count(*) AS n FROM {FILES} f GROUP BY 1) f ON f.repo = r.name LEFT JOIN (SELECT repo, count(*) AS n, count(embedding) AS e FROM {VECTORS} v GROUP BY 1) c ON c.repo = r.name""",
    "status_counts": f"SELECT count(*) AS chunks, count(embedding) AS embedded_chunks, count(embedding) < count(*) AS degraded FROM {VECTORS} v",
    "read_file_range": f"SELECT repo, path, CAST(2 AS INT) AS start_line, CAST(least(4, len(l)) AS INT) AS end_line, CASE WHEN len(l) < 2 THEN '' ELSE array_to_string(list_slice(l, 2, least(4, len(l))), chr(10)) END AS content, h AS file_hash FROM (SELECT repo, path, {LINES} AS l, sha256(content) AS h FROM {FILES} f)",
    "symbols_exact_first": f"SELECT repo, symbol, kind, path, line, chunk_id FROM {PLACED} s WHERE lower(symbol) LIKE '%m_1%' ORDER BY CASE WHEN lower(symbol) = 'm_1' THEN 0 ELSE 1 END, repo, path, line, symbol LIMIT 500",
    "line_window_chunks": f"SELECT repo, path, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, sha256(content) AS content_hash FROM {DOC_CHUNKS} c",
    "chunk_ids": f"SELECT repo, path, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, chunk_id FROM {chunk_sql('(SELECT regexp_extract(url, ' + chr(39) + '^[a-z]+://([^/:?#]+)' + chr(39) + ', 1) AS repo, ' + chr(39) + 'pages/' + chr(39) + ' || page_id || ' + chr(39) + '.html' + chr(39) + ' AS path, html AS content FROM pages)')} c",
    "symbol_extract_regex": f"SELECT * FROM {SYMBOLS} s",
    "symbol_to_chunk": f"SELECT * FROM {PLACED} s",
    "chunk_symbols": f"SELECT DISTINCT chunk_id, symbol FROM {CODE_CHUNKS} c JOIN {SYMBOLS} s ON s.repo = c.repo AND s.path = c.path WHERE regexp_matches(content, '\\b' || symbol || '\\b')",
    "kind_semi_join": f"SELECT chunk_id, path, CAST(start_line AS INT) AS start_line FROM {CODE_CHUNKS} c WHERE EXISTS (SELECT 1 FROM {PLACED} s WHERE s.chunk_id = c.chunk_id AND lower(s.kind) = 'class')",
    "fts_tokens": f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_concat({TOKENS.format('path')}, {TOKENS.format('content')})) AS term FROM {FILES} f) GROUP BY 1",
    "phrase_match": " UNION ALL ".join(f"SELECT doc_id, CAST({n} AS INT) AS phrase, {occurrences('t', ph)} AS f FROM (SELECT doc_id, {TOKENS.format('content')} AS t FROM {FILES} f) WHERE {occurrences('t', ph)} > 0" for n, ph in enumerate([["of", "the"], ["mit", "license"], ["the"]])),
    "bm25_topk": f"SELECT chunk_id, bm25 FROM {BM25} b ORDER BY bm25, repo, path, start_line, chunk_id LIMIT 100",
    "lexical_search": f"SELECT repo, path, CAST(start_line AS INT) AS start_line, round(greatest(0.2, CAST(4.0 AS DOUBLE) - 0.03 * rank), 4) AS score, CAST(rank AS INT) AS rank FROM {RANKED} r WHERE rank < 10",
    "vector_cosine_scan": f"SELECT vec_id, round(s, 4) AS similarity, round(3.0 * s, 3) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {Q}) AS s FROM embeddings) WHERE s > 0",
    "vector_knn_l2": f"SELECT vec_id, round(d, 4) AS distance, round(list_cosine_similarity(e, {Q}), 4) AS similarity FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_distance(CAST(embedding AS DOUBLE[]), {Q}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 200",
    "path_symbol_score": f"SELECT repo, path, CAST({_part} AS DOUBLE) AS path_score, CAST(CASE WHEN {_symbol} THEN 2.0 ELSE 0.0 END AS DOUBLE) AS symbol_score FROM (SELECT repo, path, lower(string_agg(DISTINCT symbol, ' ' ORDER BY symbol)) AS st FROM {SYMBOLS} s GROUP BY 1, 2)",
    "hybrid_search": f"SELECT chunk_id, repo, path, CAST(start_line AS INT) AS start_line, score, reasons AS score_reason, round(similarity, 4) AS vector_similarity FROM {FUSED} f ORDER BY f.score DESC, repo, path, f.start_line, chunk_id LIMIT 20",
    "low_confidence_flags": f"SELECT reasons = 'vector' AND (similarity IS NULL OR similarity < 0.3) AS low_confidence, reasons AS score_reason, count(*) AS n FROM (SELECT reasons, round(similarity, 4) AS similarity FROM {FUSED} f) GROUP BY 1, 2",
    "search_with_filters": f"SELECT chunk_id, path, CAST(start_line AS INT) AS start_line, score FROM {FUSED} f WHERE path GLOB '*/fr/*' AND lower({LANGUAGE}) = 'fr' ORDER BY f.score DESC, repo, path, f.start_line, chunk_id LIMIT 10",
    "snapshot_diff": f"""SELECT coalesce(p.repo, s.repo) AS repo, coalesce(p.path, s.path) AS path, CASE WHEN p.path IS NULL THEN 'deleted' WHEN NOT p.readable THEN 'skipped' WHEN s.path IS NULL THEN 'new'
      WHEN p.h = s.h AND (coalesce(c.n, 0) > 0 OR p.size = 0) THEN 'unchanged' ELSE 'changed' END AS action
      FROM {PRESENT} p FULL JOIN {STORED} s ON p.repo = s.repo AND p.path = s.path LEFT JOIN (SELECT repo, path, count(*) AS n FROM {DOC_CHUNKS} c GROUP BY 1, 2) c ON c.repo = s.repo AND c.path = s.path""",
    "delete_missing": f"SELECT repo, path FROM {STORED} s WHERE NOT EXISTS (SELECT 1 FROM {PRESENT} p WHERE p.repo = s.repo AND p.path = s.path)",
    "skip_rules": f"""SELECT DISTINCT path, len(list_intersect(string_split(path, '/'), [{quoted(sorted(SKIPPED_DIRS))}])) > 0 OR name IN ({quoted(sorted(SKIPPED_NAMES))}) OR starts_with(name, '{SKIPPED_PREFIX}') OR {_endings} AS skipped
      FROM (SELECT path, string_split(path, '/')[-1] AS name FROM (SELECT lower(n_name) || '/' || replace(shape, '{{}}', item) AS path FROM nation, (SELECT unnest([{quoted(_names)}]) AS item), (SELECT unnest(['{{}}', 'src/{{}}', '{{}}/a.py', 'x{{}}y/b.md']) AS shape)))""",
    "snippets": f"SELECT doc_id, CASE WHEN length(b) <= 500 THEN b ELSE regexp_replace(left(b, 499), '[{SPACES}]+$', '') || '...' END AS snippet FROM (SELECT doc_id, regexp_replace(regexp_replace(' ' || chr(10) || content || chr(9) || ' ', '^[{SPACES}]+', ''), '[{SPACES}]+$', '') AS b FROM {FILES} f)",
    "embedding_dims": "SELECT CAST(len(embedding) AS INT) AS dim, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS norm FROM embeddings GROUP BY 1",
    "path_languages": f"SELECT {LANGUAGE} AS language, CASE " + " ".join(f"WHEN ends_with(path, '{s}') THEN '{lang}'" for s, lang in PARSER_LANGUAGES.items()) + f" END AS parser, count(*) AS n FROM (SELECT path FROM {CODE} c UNION ALL SELECT path FROM {FILES} f UNION ALL SELECT unnest(['Makefile', '.bashrc', 'a.tar.gz', 'src/Auth.PY', 'x/.env', 'a.b/c'])) GROUP BY 1, 2",
    "change_feed_merge": """WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
      SELECT c_custkey AS user_id, 'none' AS event_type, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last) UNION ALL SELECT * FROM last WHERE event_type <> 'purchase'""",
    "windowed_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "conversations_search": f"SELECT item_id, b.term, count(*) AS turns FROM (SELECT item_id, {TOKENS.format('text')}[1] AS term FROM benchmark) b JOIN (SELECT DISTINCT conv_id, turn, unnest({TOKENS.format('text')}) AS term FROM conversations) t ON t.term = b.term GROUP BY 1, 2",
    "binary_sniff": """SELECT shape, shape <> 'plain' AND NOT (shape = 'nul' AND n >= 4096) AS "binary", n < 4096 AS short, count(*) AS n FROM (SELECT strlen(text) AS n, unnest(['plain', 'nul', 'bad']) AS shape FROM documents) GROUP BY 1, 2, 3""",
}
