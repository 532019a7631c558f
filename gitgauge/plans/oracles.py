"""The same results in SQL over the given tables, written apart from the operators, to check them against."""

from .catalog import NOW

FILES = """
files AS (
  SELECT doc_id AS file_id, lang AS repo,
    CASE doc_id % 16
      WHEN 0 THEN 'src/services/AuthService' || doc_id || '.ts'
      WHEN 1 THEN 'src/m' || doc_id || '/index.ts'
      WHEN 2 THEN 'm' || doc_id || '/package.json'
      WHEN 3 THEN 'm' || doc_id || '/README.md'
      WHEN 4 THEN 'src/lib/util' || doc_id || '.py'
      WHEN 5 THEN 'src/lib/__tests__/util' || doc_id || '.test.ts'
      WHEN 6 THEN 'jest' || doc_id || '.config.js'
      WHEN 7 THEN 'docs/guide' || doc_id || '.md'
      WHEN 8 THEN 'a/b/c/d/e/f/contracts/Token' || doc_id || '.sol'
      WHEN 9 THEN 'src/components/Button' || doc_id || '.tsx'
      WHEN 10 THEN 'src/orders/order' || doc_id || '.controller.ts'
      WHEN 11 THEN '.git/objects/x' || doc_id || '.json'
      WHEN 12 THEN 'src/latest/view' || doc_id || '.js'
      WHEN 13 THEN 'pkg' || doc_id || '/alphabet.go'
      WHEN 14 THEN 'hooks/post' || doc_id || '.ts'
      ELSE 'Makefile' || doc_id END AS path,
    text AS content, n_chars AS size
  FROM documents),
listed AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS base,
    CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder,
    regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1) AS ext
  FROM files WHERE NOT regexp_matches(path, '(^|/)\\.'))"""

SELECTED = FILES + """,
supported AS (
  SELECT * FROM listed
  WHERE ext IN ('.ts','.tsx','.js','.jsx','.mjs','.cjs','.py','.rs','.go','.java','.kt','.swift','.rb','.php','.cs','.cpp',
                '.c','.h','.md','.mdx','.json','.yaml','.yml','.toml','.graphql','.gql','.prisma','.sql')
     OR base IN ('README.md','README.mdx','package.json','pyproject.toml','Cargo.toml','go.mod','CLAUDE.md',
                 '.cursorrules','.windsurfrules')),
points AS (
  SELECT *,
    CASE WHEN base IN ('README.md','README.mdx') THEN CASE WHEN folder = '.' THEN 100 ELSE 0 END
         WHEN base IN ('package.json','pyproject.toml','Cargo.toml','go.mod','CLAUDE.md','.cursorrules','.windsurfrules')
         THEN 100 ELSE 0 END
    + CASE WHEN regexp_matches(lower(path), 'contract|protocol|hook|service|api|game|bet|flip|payment|auth|wallet')
           THEN 60 ELSE 0 END
    + CASE WHEN contains(folder, '/hooks') OR contains(folder, '/services') OR contains(folder, '/lib')
             OR contains(folder, '/api') OR contains(folder, '/contracts') OR contains(folder, '/components')
           THEN 40 ELSE 0 END
    + CASE WHEN base IN ('index','main','app','server','cli','index.ts','main.ts','app.ts','server.ts')
             OR substr(base, 1, length(base) - length(ext)) IN
                ('index','main','app','server','cli','index.ts','main.ts','app.ts','server.ts')
           THEN 50 ELSE 0 END
    + CASE WHEN contains(base, '.config.') OR contains(base, '.setup.') THEN 30 ELSE 0 END
    - CASE WHEN folder = '.' THEN 0 ELSE 1.5 * len(string_split(folder, '/')) END
    - CASE WHEN contains(base, '.test.') OR contains(base, '.spec.') OR contains(folder, '__tests__')
             OR contains(folder, 'test') THEN 10 ELSE 0 END AS score
  FROM listed),
scored AS (SELECT * REPLACE (CAST(score AS DOUBLE) AS score) FROM points WHERE score >= 0),
caps AS (
  SELECT repo, CASE WHEN count(*) > 10000 THEN 150 WHEN count(*) > 2000 THEN 120
                    WHEN count(*) > 500 THEN CAST(floor(count(*) * 0.15) AS BIGINT) ELSE 100 END AS cap
  FROM listed GROUP BY repo),
selected AS (
  SELECT repo, path, size,
    CASE lower(ext) WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript React' WHEN '.js' THEN 'JavaScript'
      WHEN '.py' THEN 'Python' WHEN '.go' THEN 'Go' WHEN '.md' THEN 'Markdown' WHEN '.json' THEN 'JSON'
      ELSE 'Unknown' END AS language, score, rank, content
  FROM (SELECT s.*, row_number() OVER (PARTITION BY s.repo ORDER BY score DESC, path) AS rank
        FROM scored s JOIN (SELECT file_id FROM supported) USING (file_id)
        WHERE NOT regexp_matches(s.path, '(^|/)(\\.git|\\.gitgauge|gitgauge)(/|$)'))
  JOIN caps USING (repo) WHERE rank <= cap)"""

CACHED = SELECTED + """,
stored AS (
  SELECT f.repo, f.path, CASE WHEN quality = 0 AND toxic = 1 THEN NULL ELSE 'summary ' || quality || toxic END AS summary
  FROM files f JOIN labels l ON f.file_id = l.doc_id),
told AS (SELECT s.*, stored.summary FROM selected s LEFT JOIN stored USING (repo, path))"""

COMMITS = """
commits AS (
  SELECT o_orderkey AS commit_id, c_nationkey AS repo, o_orderdate AS ts, o_orderstatus AS branch,
    o_orderpriority AS message, lpad(strftime(o_orderdate, '%d'), 7, '0') AS short_hash
  FROM orders JOIN customer ON o_custkey = c_custkey),
newest AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, commit_id DESC) AS rank FROM commits),
heads AS (SELECT repo, commit_id AS head_hash, short_hash, branch FROM newest WHERE rank = 1)"""

_SUFFIX = "CASE WHEN p_brand LIKE '%1' THEN '.md' WHEN p_brand LIKE '%2' THEN '.py' ELSE '.ts' END"
TOUCHES = f"""
line_paths AS (
  SELECT l.*, p.p_name, 'src/' || lower(p_type) || '/' || replace(p_brand, '#', '_') || {_SUFFIX} AS path
  FROM lineitem l JOIN part p ON l_partkey = p_partkey),
touches AS (SELECT DISTINCT l_orderkey AS commit_id, path FROM line_paths)"""

HOT = COMMITS + f""",
touches_coarse AS (
  SELECT DISTINCT l_orderkey AS commit_id, 'src/' || replace(p_brand, '#', '_') || {_SUFFIX} AS path
  FROM lineitem JOIN part ON l_partkey = p_partkey),
hot AS (
  SELECT repo, path, count(*) AS commit_count, CAST(floor(CAST(count(*) AS DOUBLE) / 10 * 100 + 0.5) AS BIGINT) AS percentage
  FROM newest JOIN touches_coarse USING (commit_id)
  WHERE rank <= 10 AND path NOT LIKE '%.md' AND path NOT LIKE '.gitgauge/%'
  GROUP BY repo, path HAVING count(*) >= 4)"""

RUN_LOG = """
run_log AS (
  SELECT event_id AS seq, user_id AS repo, ts,
    CASE event_type
      WHEN 'signup' THEN stamp || ' | Git: ' || hash || ' | STARTED'
      WHEN 'purchase' THEN stamp || ' | Git: ' || hash || ' | SUCCESS | ' || event_id % 60 || 's'
      WHEN 'error' THEN stamp || ' | Git: ' || hash || ' | FAILED | ' || event_id % 60 || 's'
      WHEN 'click' THEN stamp || ' | Git: ' || hash || ' | DOOM | detected'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'DOOM_SHOWN | Git: ' || hash ELSE 'garbled' END END AS line,
    CASE event_type WHEN 'signup' THEN 'STARTED' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED'
      WHEN 'click' THEN 'DOOM' ELSE CASE WHEN event_id % 2 = 0 THEN 'DOOM_SHOWN' END END AS status,
    stamp, hash, CASE WHEN event_type IN ('purchase', 'error') THEN event_id % 60 END AS seconds, event_type
  FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, lpad(strftime(ts, '%d'), 7, '0') AS hash FROM events))"""

PENDING = HOT + "," + RUN_LOG + """,
due AS (
  SELECT repo, short_hash, EXISTS (
      SELECT 1 FROM run_log r WHERE r.repo = h.repo AND contains(line, 'DOOM_SHOWN | Git: ' || short_hash)) AS shown
  FROM heads h WHERE EXISTS (
      SELECT 1 FROM run_log r WHERE r.repo = h.repo AND contains(line, '| Git: ' || short_hash || ' | DOOM | detected')))"""

DOCS = COMMITS + """,
kinds(doc_type, token_count) AS (VALUES ('context', 4096), ('dependency-map', 4000), ('patterns', 4000)),
docs AS (
  SELECT repo, doc_type, 'doc ' || doc_type || ' of repo ' || repo || ' at ' || commit_id AS content,
    commit_id AS commit_hash, ts AS saved_at, CAST(token_count AS BIGINT) AS token_count, rank
  FROM newest CROSS JOIN kinds
  WHERE rank = 1 AND (message IN ('1-URGENT', '5-LOW') OR message = '2-HIGH' AND doc_type <> 'patterns'
                      OR message = '3-MEDIUM' AND doc_type = 'context')
     OR rank = 2 AND doc_type <> 'dependency-map'
     OR rank = 3 AND doc_type = 'context'),
store AS (
  SELECT repo, doc_type, content, commit_hash, saved_at, token_count FROM docs
  QUALIFY rank = min(rank) OVER (PARTITION BY repo))"""

AGENT_FILES = """
agent_files AS (
  SELECT doc_id AS repo, 'CLAUDE.md' AS path,
    CASE lang
      WHEN 'en' THEN text || chr(10) || '<!-- S -->' || chr(10) || 'old' || chr(10) || '<!-- E -->' || chr(10) || chr(10)
                     || 'tail ' || text
      WHEN 'es' THEN text || chr(10) || '<!-- S -->old, no end marker'
      ELSE CASE WHEN n_chars < 500 THEN '#!/bin/sh' || chr(10) ELSE text END END AS content
  FROM documents),
blocks AS (
  SELECT doc_id AS repo, unnest(['CLAUDE.md', 'AGENTS.md']) AS path, '<!-- S -->Git: ' || doc_id || '<!-- E -->' AS block
  FROM documents)"""

# lines whose trimmed text starts with one of the prefixes, in order
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279) || chr(12288))"


def _kept(lines, *prefixes):
    tests = " OR ".join(f"starts_with({_TRIM.format('x')}, '{p}')" for p in prefixes)
    return f"list_filter({lines}, lambda x: {tests})"


def _joined(lines):
    return f"array_to_string({lines}, chr(10))"


_LINES = "string_split(text, chr(10))"
_EXPORTS = _joined(_kept(_LINES, "The ", "De "))

EDGES = """
raw AS (
  SELECT DISTINCT page_id AS source, href AS target
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)),
sections AS (
  SELECT regexp_extract(url, '^https?://[^/]*(/[^/?#]*)', 1) AS target_key, min(page_id) AS target_id
  FROM pages GROUP BY 1),
edges AS (
  SELECT source, target, target AS target_key, target_id FROM raw LEFT JOIN sections ON target = sections.target_key)"""

LAST_LINE = """
last_line AS (
  SELECT repo, arg_max(line, seq) AS line, count(*) AS n FROM run_log GROUP BY repo)"""
_LOG_STATUS = """CASE WHEN n IS NULL OR (contains(line, 'FAILED') AND NOT contains(line, 'SUCCESS')) THEN 'warn'
                 ELSE 'pass' END"""
_LOG_MESSAGE = """CASE WHEN n IS NULL THEN 'no runs on record'
       WHEN contains(line, 'SUCCESS') THEN n || CASE WHEN n = 1 THEN ' run' ELSE ' runs' END || ' on record, newest succeeded'
       WHEN contains(line, 'FAILED') THEN 'newest run failed'
       ELSE 'log holds ' || n || ' lines' END"""

CHECKS = DOCS + "," + RUN_LOG + "," + LAST_LINE + f""",
per_repo AS (
  SELECT repo, any_value(commit_hash) AS cached, count(*) AS have, bool_or(doc_type = 'context') AS c,
    bool_or(doc_type = 'dependency-map') AS d, bool_or(doc_type = 'patterns') AS p,
    max(CASE WHEN doc_type = 'context' THEN saved_at END) AS context_at
  FROM store GROUP BY repo),
wide AS (
  SELECT heads.repo, head_hash, cached, coalesce(have, 0) AS have, c, d, p,
    CAST(floor(epoch(TIMESTAMP '{NOW}' - context_at) / 3600) AS BIGINT) AS hours, files, n_regionkey AS region, n, line
  FROM heads LEFT JOIN per_repo USING (repo)
  LEFT JOIN (SELECT c_nationkey AS repo, count(*) AS files FROM customer GROUP BY 1) USING (repo)
  LEFT JOIN nation ON n_nationkey = heads.repo LEFT JOIN last_line USING (repo)),
checks AS (
  SELECT repo, 'context_files' AS name, CASE WHEN have = 0 THEN 'fail' WHEN have < 3 THEN 'warn' ELSE 'pass' END AS status,
    CASE WHEN have = 0 THEN 'nothing built so far'
         WHEN have < 3 THEN concat_ws(', ', CASE WHEN NOT c THEN 'context' END, CASE WHEN NOT d THEN 'dependency-map' END,
                                      CASE WHEN NOT p THEN 'patterns' END) || ' missing'
         ELSE have || ' files' END AS message,
    CASE WHEN have < 3 THEN 'refresh' END AS fix FROM wide
  UNION ALL
  SELECT repo, 'cache_valid', CASE WHEN cached IS NULL THEN 'fail' WHEN cached <> head_hash THEN 'warn' ELSE 'pass' END,
    CASE WHEN cached IS NULL THEN 'nothing stored' WHEN cached <> head_hash THEN 'stored for another commit'
         ELSE 'stored for the head commit' END,
    CASE WHEN cached IS NULL THEN 'refresh' WHEN cached <> head_hash THEN 'rebuild' END FROM wide
  UNION ALL
  SELECT repo, 'hook_log', {_LOG_STATUS}, {_LOG_MESSAGE},
    CASE WHEN n IS NULL THEN 'commit' WHEN {_LOG_STATUS} = 'warn' THEN 'status' END FROM wide
  UNION ALL
  SELECT repo, 'agent_file_claude-code', CASE WHEN region < 3 THEN 'pass' ELSE 'warn' END,
    CASE WHEN region < 3 THEN 'CLAUDE.md ✓' WHEN region = 3 THEN 'CLAUDE.md lacks the managed block'
         ELSE 'CLAUDE.md is absent' END,
    CASE WHEN region < 3 THEN NULL WHEN region = 3 THEN 'refresh' ELSE 'standards' END FROM wide
  UNION ALL
  SELECT repo, 'agent_file_cursor', CASE WHEN region > 1 THEN 'pass' ELSE 'warn' END,
    CASE WHEN region > 1 THEN '.cursorrules ✓' ELSE '.cursorrules is absent' END,
    CASE WHEN region > 1 THEN NULL ELSE 'standards' END FROM wide
  UNION ALL
  SELECT repo, 'agent_file_windsurf', 'warn',
    CASE WHEN region = 0 THEN '.windsurfrules lacks the managed block' ELSE '.windsurfrules is absent' END,
    CASE WHEN region = 0 THEN 'refresh' ELSE 'standards' END FROM wide
  UNION ALL
  SELECT repo, 'context_freshness',
    CASE WHEN hours IS NULL THEN 'fail' WHEN hours < 24 THEN 'pass' WHEN hours < 168 THEN 'warn' ELSE 'fail' END,
    CASE WHEN hours IS NULL THEN 'context is absent' WHEN hours < 24 THEN hours || ' h since the last build'
         ELSE CAST(floor(hours / 24) AS BIGINT) || ' d since the last build' || CASE WHEN hours < 168 THEN '' ELSE ', rebuild due' END END,
    CASE WHEN hours IS NULL THEN 'refresh' WHEN hours >= 24 THEN 'rebuild' END FROM wide
  UNION ALL
  SELECT repo, 'file_scan_sanity', CASE WHEN files BETWEEN 10 AND 500 THEN 'pass' ELSE 'warn' END,
    CASE WHEN files IS NULL THEN 'no summaries to count' WHEN files < 10 THEN 'only ' || files || ' files read'
         WHEN files > 500 THEN files || ' files read, more than expected'
         ELSE files || ' files read' END, NULL FROM wide)"""


def _with(ctes, select):
    """Query over shared CTEs; a select that starts with a comma brings more of its own."""
    return f"WITH {ctes.strip()} {select.strip()}"


_UPSERTED = """
  SELECT repo, doc_type, content, commit_hash, saved_at, token_count FROM store"""

_PROMPT_BLOCKS = "string_agg(block, chr(10) || chr(10) ORDER BY rank)"


def oracle_sql():
    from ..operators.requests import DOC_TASKS, TARGET_TASKS, TIER_TASKS

    quote = lambda s: s.replace("'", "''")
    context_task, dep_task, pattern_task = (quote(DOC_TASKS[k]) for k in ("context", "dependency-map", "patterns"))
    nl = "chr(10)"
    sql = {}

    # --- sources and stores
    sql["file_inventory"] = _with(FILES, "SELECT repo, path, size FROM listed")
    sql["ignore_filter"] = _with(FILES, "SELECT repo, path FROM files WHERE NOT contains(path, '.git/')")
    sql["ignore_files"] = _with(FILES, """
        SELECT repo, path, size FROM listed
        WHERE NOT starts_with(path, 'docs/')
          AND NOT (path LIKE '%.sol' AND path NOT LIKE 'a/b/c/d/e/f/contracts/Token1%.sol')
          AND NOT (path LIKE 'src/lib/%.test.ts') AND NOT (path LIKE 'src/components/%1.tsx')""")
    on_disk = """FROM files WHERE repo IS NOT NULL AND NOT regexp_matches(path, '(^|/)\\.') AND NOT starts_with(path, 'docs/')
    AND NOT (path LIKE '%.sol' AND path NOT LIKE 'a/b/c/d/e/f/contracts/Token1%.sol')
    AND NOT (path LIKE 'src/lib/%.test.ts') AND NOT (path LIKE 'src/components/%1.tsx'))"""
    not_hidden = "FROM files WHERE NOT regexp_matches(path, '(^|/)\\.'))"
    sql["disk_listing"] = _with(FILES.replace(not_hidden, on_disk), "SELECT repo, path, CAST(strlen(coalesce(content, '')) AS BIGINT) AS size FROM listed")
    sql["disk_scan"] = _with(SELECTED.replace(not_hidden, on_disk), "SELECT repo, path, score, rank, coalesce(content, '') AS content FROM selected")
    sql["commit_touches"] = _with(TOUCHES, """
        SELECT commit_id, path FROM touches UNION ALL SELECT commit_id, path || '.note.md' FROM touches""")
    sql["run_log_parse"] = _with(RUN_LOG, """
        SELECT repo, seq, CASE WHEN status <> 'DOOM_SHOWN' THEN CAST(stamp AS TIMESTAMP) END AS logged_at,
          CASE WHEN status IS NOT NULL THEN hash END AS commit_hash, status, CAST(NULL AS VARCHAR) AS cost,
          CASE WHEN status = 'DOOM' THEN 'detected' ELSE seconds || 's' END AS detail,
          CASE WHEN status IS NULL THEN line END AS raw
        FROM run_log""")
    sql["settings_resolve"] = """
        SELECT repo, key, arg_min(value, priority) AS value, min(priority) AS priority
        FROM (SELECT user_id AS repo, event_type AS key, event_id % 5 AS priority,
                CAST(arg_max(event_id % 100, event_id) AS VARCHAR) AS value
              FROM events WHERE NOT (event_id % 11 = 0 OR event_id % 13 = 0) GROUP BY ALL)
        GROUP BY repo, key"""
    sql["doc_store_upsert"] = _with(DOCS, _UPSERTED)
    spec_ctes = """
        specs AS (
          SELECT lang AS repo, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
            string_split(text, chr(10))[-1] AS last_line, text AS content, doc_id AS saved_at
          FROM documents),
        registry AS (
          SELECT repo, slug, arg_max(content, saved_at) AS content, max(saved_at) AS saved_at, count(*) AS saves
          FROM specs GROUP BY repo, slug)"""
    sql["spec_registry"] = _with(spec_ctes, "SELECT * FROM registry")
    sql["spec_list"] = _with(FILES, """
        SELECT repo, regexp_extract(path, '([^/]*)\\.md$', 1) AS slug FROM listed WHERE path LIKE '%.md'""")
    sql["spec_load"] = _with(spec_ctes, """
        SELECT w.repo, w.task, w.slug, r.content
        FROM (SELECT DISTINCT repo, last_line AS task,
                trim(regexp_replace(lower(last_line), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM specs) w
        LEFT JOIN registry r USING (repo, slug)""")

    # --- scan
    sql["language_profile"] = _with(FILES, """
        SELECT repo, CASE lower(ext) WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript React'
            WHEN '.js' THEN 'JavaScript' WHEN '.py' THEN 'Python' WHEN '.go' THEN 'Go' WHEN '.md' THEN 'Markdown'
            WHEN '.json' THEN 'JSON' ELSE 'Unknown' END AS language,
          count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
        FROM listed GROUP BY 1, 2""")
    sql["scan_summary"] = _with(SELECTED, f"""
        SELECT repo, (SELECT count(*) FROM listed l WHERE l.repo = h.repo) AS total_files,
          (SELECT count(*) FROM selected s WHERE s.repo = h.repo) AS selected_files,
          CAST(head AS VARCHAR) AS head_hash, TIMESTAMP '{NOW}' AS scanned_at
        FROM (SELECT lang AS repo, max(doc_id) AS head FROM documents GROUP BY 1) h""")
    sql["supported_filter"] = _with(SELECTED, "SELECT repo, path FROM supported")
    sql["relevance_score"] = _with(SELECTED, "SELECT repo, path, score FROM scored")
    implementation = """
        implementation AS (
          SELECT * EXCLUDE rank, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank
          FROM selected
          WHERE NOT regexp_matches(lower(path), '(^|/)(index\\.ts|index\\.js|package\\.json)$')
            AND (score > 50 OR regexp_matches(lower(path), '\\.(controller|service|resolver|dto|guard|middleware|decorator|'
                                              || 'filter|pipe|interceptor|entity|model)\\.'))
          QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) <= 12)"""
    sql["implementation_files"] = _with(SELECTED + "," + implementation, "SELECT repo, path, score, rank FROM implementation")
    sql["source_change_gate"] = _with(COMMITS + "," + TOUCHES, """
        SELECT repo, commit_id, EXISTS (
            SELECT 1 FROM touches t WHERE t.commit_id = c.commit_id
              AND string_split(path, '.')[-1] IN ('ts','js','tsx','jsx','py','go','rs','java','c','cpp','h','hpp','rb','php',
                'swift','kt','cs','scala','r','m','sh','bash','sql','graphql','proto','vue','svelte')) AS refresh
        FROM commits c""")

    # --- top-k
    sql["adaptive_top_n"] = _with(SELECTED, "SELECT repo, path, size, language, score, rank FROM selected")
    sql["last_n_commits"] = _with(COMMITS, "SELECT repo, commit_id, ts, rank FROM newest WHERE rank <= 10")
    sql["tail_n"] = _with(RUN_LOG, """
        SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY seq DESC) AS rank, line,
          count(*) OVER (PARTITION BY repo) AS total
        FROM run_log QUALIFY rank <= 10""")
    sql["last_run_status"] = _with(RUN_LOG + "," + LAST_LINE, f"""
        SELECT c_custkey AS repo, {_LOG_STATUS} AS status, {_LOG_MESSAGE} AS message, coalesce(n, 0) AS entries
        FROM customer LEFT JOIN last_line ON repo = c_custkey""")
    sql["preview_with_rest"] = _with(SELECTED, """
        SELECT repo, rank AS row_no, CASE WHEN length(path) > 47 THEN '...' || right(path, 44) ELSE path END AS file, language,
          (size * 20 + 1024) // 2048 // 10 || '.' || (size * 20 + 1024) // 2048 % 10 AS size_kb
        FROM selected WHERE rank <= 8
        UNION ALL
        SELECT repo, 9, '... and ' || count(*) - 8 || ' more files', '', '' FROM selected GROUP BY repo HAVING count(*) > 8""")
    sql["work_batches"] = _with(SELECTED, "SELECT repo, path, rank, (rank - 1) // 10 AS batch_id FROM selected")

    # --- history
    sql["churn_exclude"] = _with(TOUCHES, "SELECT * FROM touches WHERE path NOT LIKE '%.md'")
    sql["changed_in_head"] = _with(COMMITS + "," + TOUCHES, """
        SELECT repo, path FROM heads JOIN touches ON commit_id = head_hash""")
    sql["changed_since"] = _with(COMMITS + "," + TOUCHES, """
        SELECT DISTINCT c.repo, path FROM newest c JOIN touches USING (commit_id)
        WHERE c.rank < (SELECT min(rank) FROM newest u WHERE u.repo = c.repo AND u.message = '1-URGENT')""")
    sql["hot_files"] = _with(HOT, "SELECT * FROM hot")
    sql["hot_summary"] = _with(HOT, """
        SELECT n_nationkey AS repo, count(path) > 0 AS detected, CAST(10 AS BIGINT) AS commits_analyzed,
          count(path) AS hot_files, coalesce(max(commit_count), 0) AS max_count
        FROM nation LEFT JOIN hot ON repo = n_nationkey GROUP BY 1""")
    due = "SELECT repo, short_hash, path, commit_count, percentage FROM hot JOIN due USING (repo)"
    sql["pending_alerts"] = _with(PENDING, due + " WHERE NOT shown")
    sql["pending_alerts_stateless"] = _with(PENDING, due)
    sql["alert_text"] = _with(HOT, """
        SELECT repo, commit_count, path, '  ' || path || ' (' || commit_count || ' times · ' || percentage || '%)' AS line
        FROM hot""")
    sql["recent_commits_digest"] = _with(COMMITS, """
        SELECT repo, string_agg(commit_id || ' ' || message, chr(10) ORDER BY rank) AS digest
        FROM newest WHERE rank <= 5 GROUP BY repo""")
    runs = RUN_LOG + """,
        runs AS (
          SELECT repo, hash AS commit_hash, min(CAST(stamp AS TIMESTAMP)) FILTER (status = 'STARTED') AS started_at,
            arg_max({'at': CAST(stamp AS TIMESTAMP), 'status': status, 'seconds': seconds}, seq)
              FILTER (status IN ('SUCCESS', 'FAILED')) AS fin
          FROM run_log WHERE status IS NOT NULL GROUP BY repo, hash),
        durations AS (
          SELECT repo, commit_hash, started_at, CASE WHEN fin.at >= started_at THEN fin.at END AS finished_at,
            CASE WHEN fin.at >= started_at THEN fin.status ELSE 'OPEN' END AS status,
            CASE WHEN fin.at >= started_at THEN fin.seconds END AS seconds
          FROM runs WHERE started_at IS NOT NULL)"""
    sql["run_durations"] = _with(runs, "SELECT * FROM durations")
    sql["run_success_rate"] = _with(runs, """
        SELECT repo, count(*) AS runs, count(*) FILTER (status = 'SUCCESS') AS succeeded,
          round(count(*) FILTER (status = 'SUCCESS') / count(*), 6) AS rate, CAST(sum(seconds) AS BIGINT) AS seconds
        FROM durations GROUP BY repo""")
    sql["session_handoff"] = _with(COMMITS + "," + TOUCHES, """,
        tree AS (
          SELECT repo, CASE l_returnflag WHEN 'A' THEN 'staged' WHEN 'N' THEN 'unstaged' ELSE 'committed' END AS kind,
            path, l_linenumber AS seq, '+++ b/' || path || ' ' || p_name AS line
          FROM heads JOIN line_paths ON l_orderkey = head_hash),
        parts AS (
          SELECT repo, string_agg(line, chr(10) ORDER BY seq, line) FILTER (kind = 'staged') AS s,
            string_agg(line, chr(10) ORDER BY seq, line) FILTER (kind = 'unstaged') AS u,
            string_agg(line, chr(10) ORDER BY seq, line) FILTER (kind = 'committed') AS c
          FROM tree GROUP BY repo),
        files AS (SELECT DISTINCT repo, path FROM tree WHERE kind <> 'committed'),
        listed AS (SELECT repo, sum(length(path) + 1) AS chars FROM files GROUP BY repo),
        digests AS (
          SELECT repo, string_agg(commit_id || ' ' || message, chr(10) ORDER BY rank) AS digest
          FROM newest WHERE rank <= 5 GROUP BY repo),
        docs AS (
          SELECT n_nationkey AS repo, coalesce(branch, 'unknown') AS branch, chars, digest,
            coalesce(nullif(concat_ws(chr(10) || chr(10), s, u), ''), c, '') AS diff,
            CASE WHEN branch = 'O' THEN 'close open orders' END AS goal
          FROM nation LEFT JOIN heads h ON h.repo = n_nationkey LEFT JOIN parts p ON p.repo = n_nationkey
          LEFT JOIN listed l ON l.repo = n_nationkey LEFT JOIN digests d ON d.repo = n_nationkey),
        written AS (
          SELECT repo, diff <> '' OR chars IS NOT NULL AS has_changes, chars,
            '# Hand-over' || chr(10) || chr(10) || '**Branch**: ' || branch || chr(10) || chr(10) AS title,
            '## Modified Files' || chr(10) || chr(10)
              || CASE WHEN chars IS NULL THEN 'None' || chr(10) ELSE '' END AS heading,
            chr(10) || '## Last commits' || chr(10) || chr(10) || '```' || chr(10) || coalesce(digest, '') || chr(10) || '```'
              || chr(10) || chr(10) || '## Diff' || chr(10) || chr(10) || '```diff' || chr(10) || substr(diff, 1, 60)
              || CASE WHEN length(diff) > 60 THEN chr(10) || '...(truncated)' ELSE '' END || chr(10) || '```' || chr(10)
              || coalesce(chr(10) || '## Goal' || chr(10) || chr(10) || goal || chr(10), '') AS rest,
            '## State' || chr(10) || chr(10) || 'Nothing is modified.' || chr(10) || chr(10)
              || '## Last commits' || chr(10) || chr(10) || '```' || chr(10) || coalesce(digest, 'none')
              || chr(10) || '```' || chr(10) || chr(10) || '## What comes next' || chr(10) || chr(10)
              || coalesce(goal, 'No goal is set.') || chr(10) AS idle
          FROM docs)
        SELECT repo, CAST(0 AS BIGINT) AS section, CAST(NULL AS VARCHAR) AS path, has_changes,
          title || CASE WHEN has_changes THEN heading ELSE idle END AS content,
          CASE WHEN has_changes THEN CAST(ceil((length(title || heading || rest) + coalesce(chars, 0)) / 4) AS BIGINT)
            ELSE 0 END AS token_count
        FROM written
        UNION ALL
        SELECT repo, 1, path, true, path || chr(10), 0 FROM files WHERE repo IN (SELECT n_nationkey FROM nation)
        UNION ALL
        SELECT repo, 2, NULL, true, rest, 0 FROM written WHERE has_changes""")

    # --- text
    exports = f"{nl} || {nl} || '// Exports:' || {nl} || {_EXPORTS}"
    sql["smart_truncate"] = f"""
        SELECT doc_id, len({_LINES}) AS n_lines, len({_LINES}) > 5 AS truncated,
          CASE WHEN len({_LINES}) <= 5 THEN text
               WHEN len({_LINES}) <= 20 THEN {_joined(_LINES + '[1:4]')} || {nl} || {nl}
                 || '// ... (middle section truncated) ...' || {exports}
               ELSE {_joined(_LINES + '[1:3]')} || {nl} || {nl} || '// ... (large file truncated) ...' || {exports} END
          AS content
        FROM documents"""
    sql["export_lines"] = f"""
        SELECT doc_id, generate_subscripts(kept, 1) - 1 AS pos, unnest(kept) AS line
        FROM (SELECT doc_id, {_kept(_LINES, 'The ', 'De ')} AS kept FROM documents)"""
    sql["char_budget"] = """
        SELECT doc_id, length(text) > 3000 AS cut,
          substr(text, 1, 3000) || CASE WHEN length(text) > 3000 THEN ' ...(truncated)' ELSE '' END AS content
        FROM documents"""
    sql["head_excerpt"] = f"""
        SELECT doc_id, {_joined(_LINES + '[1:5]')}
          || CASE WHEN len({_LINES}) > 5 THEN {nl} || '// ... (truncated at 5 lines)' ELSE '' END AS content
        FROM documents"""
    sql["token_estimate"] = """
        SELECT lang AS repo, count(*) AS docs, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens
        FROM documents GROUP BY lang"""
    secrets = """
        secrets AS (
          SELECT doc_id, repo, secret, CASE WHEN secret LIKE '2%' THEN 'digit' WHEN secret LIKE 'f%' THEN 'letter'
            ELSE 'other' END AS kind
          FROM (SELECT doc_id, lang AS repo, unnest(regexp_extract_all(text, 'token = "([^"]+)"', 1)) AS secret FROM documents))"""
    sql["credential_scan"] = _with(secrets, """
        SELECT doc_id, repo, kind, substr(secret, 1, 6) || '...' || right(secret, 4) AS masked,
          CASE WHEN length(secret) <= 8 THEN '***' ELSE substr(secret, 1, 8) || '...' || right(secret, 4) END AS masked_short
        FROM secrets""")
    sql["credential_counts"] = _with(secrets, """
        SELECT repo, kind, count(*) AS findings, count(DISTINCT doc_id) AS docs FROM secrets GROUP BY repo, kind""")
    sql["instruction_blocks"] = _with(COMMITS, """,
        agents AS (
          SELECT n_nationkey AS repo, 'CLAUDE.md' AS path, '## ' AS mark FROM nation WHERE n_regionkey <= 3
          UNION ALL SELECT n_nationkey, '.cursorrules', '# ' FROM nation WHERE n_regionkey > 1
          UNION ALL SELECT n_nationkey, '.windsurfrules', '# ' FROM nation WHERE n_regionkey = 0)
        SELECT repo, path, concat_ws(chr(10), '<!-- gitgauge:begin -->', mark || 'Repository context', '',
            'Load the repository context at the start of every session: call `load_context`, or read',
            '- .gitgauge/context.md', '- .gitgauge/patterns.md', '- .gitgauge/dependency-map.md', '',
            'Last updated: 1998-12-31 | Git: ' || left(CAST(head_hash AS VARCHAR), 8), '<!-- gitgauge:end -->') AS block
        FROM agents JOIN heads USING (repo)""")
    sql["managed_block_upsert"] = _with(AGENT_FILES, """
        SELECT repo, path, CASE WHEN block IS NULL THEN 'kept' WHEN content IS NULL THEN 'created' ELSE 'updated' END AS action,
          CASE WHEN block IS NULL THEN content
               WHEN content IS NULL THEN block || chr(10)
               WHEN strpos(content, '<!-- S -->') = 0 THEN content || chr(10) || chr(10) || block || chr(10)
               WHEN strpos(content, '<!-- E -->') = 0 THEN substr(content, 1, strpos(content, '<!-- S -->') - 1) || block
               ELSE substr(content, 1, strpos(content, '<!-- S -->') - 1) || block
                 || substr(content, strpos(content, '<!-- E -->') + 10) END AS content
        FROM agent_files FULL JOIN blocks USING (repo, path)""")
    sql["managed_block_remove"] = _with(AGENT_FILES, f""",
        split AS (
          SELECT repo, path, content, unnest(string_split(content, chr(10))) AS line,
            generate_subscripts(string_split(content, chr(10)), 1) AS i
          FROM agent_files),
        flagged AS (
          SELECT *, contains(line, '<!-- S -->') AS marked,
            max(CASE WHEN contains(line, '<!-- S -->') THEN i ELSE 0 END) OVER before AS last_mark,
            max(CASE WHEN {_TRIM.format('line')} = '' THEN i ELSE 0 END) OVER before AS last_blank
          FROM split
          WINDOW before AS (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        rest AS (
          SELECT repo, path, any_value(content) AS content, {_TRIM.format('''coalesce(string_agg(line, chr(10) ORDER BY i)
            FILTER (NOT (marked OR coalesce(last_mark, 0) > coalesce(last_blank, 0))), '')''')} AS kept
          FROM flagged GROUP BY repo, path),
        judged AS (
          SELECT *, (contains(content, '<!-- S -->') AND NOT contains(content, ' the '))
            OR kept IN ('', '#!/bin/sh', '#!/usr/bin/env sh') AS gone FROM rest)
        SELECT repo, path, CASE WHEN gone THEN 'deleted' ELSE 'rewritten' END AS action,
          CASE WHEN NOT gone THEN kept || chr(10) END AS content
        FROM judged""")
    sql["reference_append"] = _with(AGENT_FILES, """
        SELECT repo, path, 'updated' AS action,
          content || CASE WHEN content LIKE '%' || chr(10) THEN chr(10) ELSE chr(10) || chr(10) END || '---' || chr(10) || chr(10)
          || '**Active Spec:** Read `.gitgauge/specs/s-git-' || repo || '-e.md` before implementing this feature.' || chr(10)
          AS content
        FROM agent_files JOIN blocks USING (repo, path)""")

    # --- cache
    sql["cache_validity"] = _with(DOCS, """
        SELECT h.repo, head_hash, cached AS cached_hash, cached IS NOT NULL AND cached = head_hash AS valid
        FROM heads h LEFT JOIN (SELECT DISTINCT repo, commit_hash AS cached FROM docs WHERE rank = 1) USING (repo)""")
    sql["complete_doc_set"] = _with(DOCS, """
        SELECT repo, head_hash, count(d.doc_type) = 3 AS complete,
          coalesce(string_agg(k.doc_type, ',' ORDER BY k.doc_type) FILTER (d.doc_type IS NULL), '') AS missing
        FROM (SELECT repo, head_hash, doc_type FROM heads CROSS JOIN kinds) k
        LEFT JOIN (SELECT repo, commit_hash AS head_hash, doc_type FROM docs) d USING (repo, head_hash, doc_type)
        GROUP BY repo, head_hash""")
    sql["incremental_plan"] = _with(CACHED, """
        SELECT repo, path, rank, CASE WHEN redo THEN 'summarise' ELSE 'reuse' END AS action,
          CASE WHEN NOT redo THEN summary END AS summary
        FROM (SELECT t.*, t.summary IS NULL OR d.source = 'src7' AS redo
              FROM told t JOIN files f USING (repo, path) JOIN documents d ON d.doc_id = f.file_id)""")
    sql["summary_store_upsert"] = _with(CACHED, """
        SELECT * FROM stored WHERE repo NOT IN (SELECT repo FROM selected WHERE repo IN ('fr', 'de'))
        UNION ALL
        SELECT repo, path, CASE WHEN d.source <> 'src7' THEN summary END
        FROM told t JOIN files f USING (repo, path) JOIN documents d ON d.doc_id = f.file_id WHERE repo IN ('fr', 'de')""")
    sql["load_context"] = _with(
        DOCS + "," + PENDING.replace(COMMITS + ",", "", 1), """,
        alerts AS (SELECT repo, count(*) AS n_lines FROM hot JOIN due USING (repo) GROUP BY repo),
        texts AS (
          SELECT repo, any_value(commit_hash) AS cached_hash,
            '# Repository Context' || chr(10) || chr(10) || max(content) FILTER (doc_type = 'context')
            || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Dependency Map' || chr(10) || chr(10)
            || max(content) FILTER (doc_type = 'dependency-map')
            || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Patterns' || chr(10) || chr(10)
            || max(content) FILTER (doc_type = 'patterns') AS content
          FROM store GROUP BY repo)
        SELECT h.repo, content IS NOT NULL AS from_cache,
          content IS NOT NULL AND cached_hash <> head_hash AS stale, cached_hash, head_hash AS current_hash, content,
          coalesce(n_lines, 0) AS alert_files,
          'files changed again and again in recent commits: ' || n_lines AS alert
        FROM heads h LEFT JOIN texts USING (repo) LEFT JOIN alerts USING (repo)""")

    # --- requests and costs
    brief = quote(TIER_TASKS["brief"])
    file_lines = "string_split(content, chr(10))"
    exported = _joined(_kept(file_lines, "export ", "exports.", "module.exports"))
    code_exports = f"""CASE WHEN language = 'Python' THEN {_joined(
        f'''list_filter({file_lines}, lambda x: starts_with({_TRIM.format('x')}, 'export ')
            OR starts_with({_TRIM.format('x')}, 'exports.') OR starts_with({_TRIM.format('x')}, 'module.exports')
            OR starts_with(x, 'def ') OR starts_with(x, 'class '))''')} ELSE {exported} END"""
    summarised = f""",
        cut AS (
          SELECT *, len({file_lines}) AS n, {code_exports} AS exports,
            CASE WHEN len({file_lines}) <= 200 THEN content
                 WHEN len({file_lines}) <= 500 THEN {_joined(file_lines + '[1:150]')} || {nl} || {nl}
                   || '// ... (middle section truncated) ...' || {nl} || {nl} || '// Exports:' || {nl} || {code_exports}
                 ELSE {_joined(file_lines + '[1:100]')} || {nl} || {nl}
                   || '// ... (large file truncated) ...' || {nl} || {nl} || '// Exports:' || {nl} || {code_exports} END AS body
          FROM selected),
        prompts AS (
          SELECT *, '{brief}' || {nl} || {nl} || 'File: ' || path || {nl} || {nl} || '```' || lower(language) || {nl}
            || substr(body, 1, 3000) || CASE WHEN n > 200 OR length(body) > 3000 THEN ' ...(truncated)' ELSE '' END
            || {nl} || '```' || {nl} AS prompt
          FROM cut),
        fresh AS (
        SELECT repo, path,
          CASE WHEN content = '' THEN NULL WHEN exports <> '' THEN exports
               ELSE array_to_string(string_split_regex({_TRIM.format('content')}, '\\s+')[1:50], ' ') END AS summary,
          CASE WHEN content = '' THEN 0 ELSE CAST(ceil(length(prompt) / 4) AS BIGINT) END AS tokens
        FROM prompts)"""
    sql["batch_summarize"] = _with(SELECTED + summarised, "SELECT * FROM fresh")
    told = "coalesce(nullif(summary, ''), 'No summary available')"
    sql["prompt_assemble"] = _with(CACHED, f"""
        SELECT repo, count(*) AS n_files, '{context_task}' || {nl} || {nl} || {_PROMPT_BLOCKS} AS prompt
        FROM (SELECT repo, rank, '### ' || path || ' (' || language || ')' || {nl} || {told} AS block FROM told)
        GROUP BY repo""")
    sql["prompt_dependency"] = _with(CACHED, f"""
        SELECT repo, count(*) AS n_files, '{dep_task}' || {nl} || {nl} || {_PROMPT_BLOCKS} AS prompt
        FROM (SELECT repo, rank, '### ' || path || {nl} || {told} AS block FROM told
              WHERE NOT lower(path) LIKE '%readme.md')
        GROUP BY repo""")
    sql["prompt_patterns"] = _with(SELECTED + "," + implementation, f"""
        SELECT repo, count(*) AS n_files, '{pattern_task}' || {nl} || {nl} || {_PROMPT_BLOCKS} AS prompt
        FROM (SELECT repo, rank, '### ' || path || ' (' || language || ')' || {nl} || '```' || lower(language) || {nl}
                || {_joined(file_lines + '[1:200]')}
                || CASE WHEN len({file_lines}) > 200 THEN {nl} || '// ... (truncated at 200 lines)' ELSE '' END
                || {nl} || '```' AS block
              FROM implementation WHERE content <> '')
        GROUP BY repo""")
    sql["build_context"] = _with(CACHED + summarised + "," + implementation, f""",
        known AS (
          SELECT t.repo, t.path, t.language, t.rank,
            coalesce(nullif(CASE WHEN t.summary IS NULL OR d.source = 'src7' THEN f.summary ELSE t.summary END, ''),
                     'No summary available') AS summary
          FROM told t JOIN files USING (repo, path) JOIN documents d ON d.doc_id = files.file_id JOIN fresh f USING (repo, path)),
        made AS (
          SELECT repo, 'context' AS doc_type, '{context_task}' || {nl} || {nl} || {_PROMPT_BLOCKS} AS content
          FROM (SELECT repo, rank, '### ' || path || ' (' || language || ')' || {nl} || summary AS block FROM known) GROUP BY repo
          UNION ALL
          SELECT repo, 'dependency-map', '{dep_task}' || {nl} || {nl} || {_PROMPT_BLOCKS}
          FROM (SELECT repo, rank, '### ' || path || {nl} || summary AS block FROM known
                WHERE NOT lower(path) LIKE '%readme.md') GROUP BY repo
          UNION ALL
          SELECT repo, 'patterns', prompt FROM ({sql["prompt_patterns"].split("implementation AS", 1)[1].split("<= 12)", 1)[1]}))
        SELECT repo, doc_type, content, (SELECT max(doc_id) FROM documents WHERE lang = repo) AS commit_hash,
          TIMESTAMP '{NOW}' AS saved_at, CAST(ceil(length(content) / 4) AS BIGINT) AS token_count
        FROM made WHERE repo <> 'fr'""")
    sql["message_split"] = """
        SELECT conv_id, CASE WHEN role = 'system' THEN 'system' ELSE 'message' END AS kind, turn AS pos, role, text
        FROM conversations WHERE role IS NOT NULL"""
    rows = ", ".join(
        f"('{t}', '{p}', {n}, '{quote(TARGET_TASKS[t])}')"
        for t, p, n in (("claude-code", "CLAUDE.md", 3000), ("cursor", ".cursorrules", 2500),
                        ("windsurf", ".windsurfrules", 2500)))
    sql["request_fanout"] = f"""
        SELECT s_name AS repo, target, path, CAST(max_tokens AS BIGINT) AS max_tokens,
          task || {nl} || {nl} || '- Language: ' || lower(s_name) || {nl} || '- Framework: spring' || {nl}
          || '- Testing: junit' || {nl} || '- Style guide: plain' || {nl} || '- Anti-patterns to avoid: globals, ' || s_name
          || ', deep nesting' || {nl} || '- Architecture notes: layers' AS prompt
        FROM supplier CROSS JOIN (VALUES {rows}) v(target, path, max_tokens, task)"""
    sql["spec_prompt"] = _with(DOCS, f"""
        SELECT n_nationkey AS repo, trim(regexp_replace(lower('Fix: ' || n_name || ' (v2)'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
          content IS NOT NULL AS has_context,
          'Write a spec for this task from the answers.' || {nl} || {nl} || 'Task: "Fix: ' || n_name || ' (v2)"' || {nl}
          || 'Repo: ' || n_nationkey || {nl} || {nl} || 'Problem: ' || n_name || ' is slow' || {nl} || 'Approach: cache it' || {nl}
          || 'Out of scope: rewrites' || {nl} || 'Done criteria: tests pass' || {nl} || 'Risks: stale data'
          || coalesce({nl} || {nl} || 'Context (first 200 lines):' || {nl} || content, '') || {nl} AS prompt,
          'fast' AS tier, CAST(800 AS BIGINT) AS max_tokens
        FROM nation LEFT JOIN (SELECT repo, content FROM docs WHERE rank = 1 AND doc_type = 'context') ON repo = n_nationkey""")
    sql["cost_rollup"] = _with(DOCS, """,
        prices(provider, tier, usd) AS (
          VALUES ('anthropic', 'fast', 0.25::DOUBLE), ('anthropic', 'mid', 3), ('anthropic', 'smart', 15),
                 ('openai', 'fast', 0.15), ('openai', 'mid', 2.5), ('openai', 'smart', 10)),
        usage AS (
          SELECT *, CASE doc_type WHEN 'patterns' THEN 'fast' WHEN 'context' THEN 'smart' ELSE 'mid' END AS tier FROM docs)
        SELECT provider, repo, doc_type, CAST(sum(token_count) AS BIGINT) AS tokens,
          round(sum(token_count / 1e6 * CASE provider WHEN 'anthropic' THEN 3 ELSE 2.5 END), 6) AS charged_usd,
          round(sum(token_count / 1e6 * usd), 6) AS by_tier_usd
        FROM usage JOIN prices USING (tier)
        GROUP BY GROUPING SETS ((provider), (provider, repo), (provider, repo, doc_type))""")
    sql["cost_estimate"] = _with(SELECTED, """,
        sized AS (SELECT repo, count(*) AS n FROM selected GROUP BY repo),
        steps AS (
          SELECT repo, n AS files, 'file summaries' AS label, n * 500 AS tokens FROM sized
          UNION ALL SELECT repo, n, 'context', 5000 FROM sized
          UNION ALL SELECT repo, n, 'dependency-map', 3000 FROM sized
          UNION ALL SELECT repo, n, 'patterns', 3000 FROM sized
          UNION ALL SELECT repo, n, 'total', n * 500 + 11000 FROM sized)
        SELECT *, CAST(ceil(tokens * 1.4) AS BIGINT) AS buffered_tokens,
          CASE WHEN label = 'total' THEN round(CAST(tokens AS DOUBLE) / 1e6 * 3, 6) END AS usd,
          CASE WHEN label = 'total' THEN round(CAST(tokens AS DOUBLE) / 1e6 * 3 * 1.4::DOUBLE, 6) END AS buffered_usd
        FROM steps""")

    # --- links
    graph = """
        said AS (
          SELECT repo, path AS source, file_id AS d, unnest(CASE file_id % 16
            WHEN 0 THEN [
              {'spec': '../m' || (file_id + 1), 'name': '', 'target': 'src/m' || (file_id + 1) || '/index.ts', 'package': NULL},
              {'spec': '../lib/util' || (file_id + 4), 'name': '', 'target': NULL, 'package': NULL},
              {'spec': 'express', 'name': '', 'target': NULL, 'package': 'express'},
              {'spec': './AuthService' || (file_id + 16) || '.js', 'name': '', 'target': 'src/services/AuthService' || (file_id + 16) || '.ts', 'package': NULL},
              {'spec': '@/components/Button' || (file_id + 9), 'name': '', 'target': 'src/components/Button' || (file_id + 9) || '.tsx', 'package': NULL}]
            WHEN 4 THEN [
              {'spec': '.', 'name': 'util' || (file_id + 16), 'target': 'src/lib/util' || (file_id + 16) || '.py', 'package': NULL},
              {'spec': '.', 'name': 'util' || (file_id + 48), 'target': 'src/lib/util' || (file_id + 48) || '.py', 'package': NULL},
              {'spec': 'os', 'name': '', 'target': NULL, 'package': 'os'},
              {'spec': 'src.lib.util' || (file_id + 32), 'name': '', 'target': 'src/lib/util' || (file_id + 32) || '.py', 'package': 'src'},
              {'spec': 'numpy.linalg', 'name': 'norm', 'target': NULL, 'package': 'numpy'}]
            WHEN 9 THEN [
              {'spec': '@scope/kit/sub', 'name': '', 'target': NULL, 'package': '@scope/kit'},
              {'spec': './Button' || (file_id + 16), 'name': '', 'target': 'src/components/Button' || (file_id + 16) || '.tsx', 'package': NULL},
              {'spec': 'node:fs', 'name': '', 'target': NULL, 'package': 'fs'}]
            WHEN 13 THEN [
              {'spec': 'fmt', 'name': '', 'target': NULL, 'package': 'fmt'},
              {'spec': 'github.com/org/mod/pkg', 'name': '', 'target': NULL, 'package': 'github.com/org/mod'},
              {'spec': 'strings', 'name': '', 'target': NULL, 'package': 'strings'}] END) AS i
          FROM files WHERE repo IS NOT NULL),
        graph AS (
          SELECT s.repo, s.source, s.i.spec AS spec, s.i.name AS name, f.path AS target, CASE WHEN f.path IS NULL THEN s.i.package END AS package
          FROM said s LEFT JOIN files f ON f.repo = s.repo AND f.path = s.i.target)"""
    sql["module_graph"] = _with(FILES + "," + graph, "SELECT * FROM graph")
    sql["module_packages"] = _with(FILES + "," + graph, """
        SELECT repo, package, count(DISTINCT source) AS n_files FROM graph WHERE package IS NOT NULL GROUP BY ALL""")
    sql["module_users"] = _with(FILES + "," + graph, """
        SELECT repo, target AS path, count(DISTINCT source) AS n_files FROM graph WHERE target IS NOT NULL GROUP BY ALL""")
    sql["link_edges"] = _with(EDGES, "SELECT * FROM edges")
    sql["external_usage"] = _with(EDGES, """
        SELECT DISTINCT target AS package, source FROM edges WHERE target_id IS NULL""")
    sql["package_counts"] = _with(EDGES, """
        SELECT target AS package, count(DISTINCT source) AS n_files FROM edges WHERE target_id IS NULL GROUP BY target""")

    # --- health
    sql["health_checks"] = _with(CHECKS, "SELECT * FROM checks")
    sql["health_score"] = _with(CHECKS, """
        SELECT repo, count(*) FILTER (status = 'pass') AS passed, count(*) AS total, bool_or(status = 'fail') AS any_fail,
          CAST(bool_or(status = 'fail') AS BIGINT) AS exit_code
        FROM checks GROUP BY repo""")

    # --- streams
    sql["stream_refresh"] = _with(COMMITS + "," + TOUCHES, """
        SELECT repo, path, commit_id, 'export const part = ''' || name || '''' AS summary
        FROM (SELECT repo, path, commit_id, ts, max(p_name) AS name
              FROM commits JOIN line_paths ON l_orderkey = commit_id
              WHERE commit_id IN (SELECT commit_id FROM touches WHERE path NOT LIKE '%.md')
              GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY ts DESC, commit_id DESC) = 1""")
    sql["stream_hot_files"] = sql["hot_files"]
    sql["stream_alert_once"] = _with(RUN_LOG, """
        SELECT repo, hash AS commit_hash FROM run_log GROUP BY repo, hash
        HAVING min(seq) FILTER (status = 'DOOM') < coalesce(min(seq) FILTER (status = 'DOOM_SHOWN'), 9223372036854775807)""")
    sql["stream_refresh_log"] = _with(COMMITS + "," + TOUCHES, """
        SELECT repo, commit_id, unnest(['STARTED', 'SUCCESS']) AS status FROM commits
        WHERE commit_id IN (SELECT commit_id FROM touches WHERE path NOT LIKE '%.md')""")
    sql["stream_run_lifecycle"] = _with(RUN_LOG, """,
        lines AS (
          SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
          FROM run_log WHERE status IN ('STARTED', 'SUCCESS', 'FAILED') WINDOW w AS (PARTITION BY repo, hash ORDER BY ts)),
        sessions AS (SELECT *, sum(opens) OVER (PARTITION BY repo, hash ORDER BY ts) AS session FROM lines),
        runs AS (
          SELECT repo, hash AS commit_hash, min(ts) FILTER (status = 'STARTED') AS started_at,
            arg_max({'at': ts, 'status': status, 'seconds': seconds}, ts) FILTER (status <> 'STARTED') AS fin,
            max(ts) AS last
          FROM sessions GROUP BY repo, hash, session)
        SELECT repo, commit_hash, started_at, CASE WHEN fin.at >= started_at THEN fin.at END AS finished_at,
          CASE WHEN fin.at >= started_at THEN fin.status WHEN last + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM run_log) - INTERVAL 1 HOUR
            THEN 'TIMED_OUT' ELSE 'OPEN' END AS status,
          CASE WHEN fin.at >= started_at THEN fin.seconds END AS seconds
        FROM runs
        WHERE started_at IS NOT NULL""")
    return sql
