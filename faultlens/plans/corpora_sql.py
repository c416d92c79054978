"""The derived corpora and the steps on them as SQL, for checking the Spark results.

Every entry of ``CTES`` is a named common table expression with the names it needs;
``sql`` puts the needed ones in front of a query.
"""

from __future__ import annotations

from faultlens.functions import logtext
from faultlens.functions import paths as fp
from faultlens.operators import rulebook as rb
from faultlens.plans import corpora as c

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({items(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def fill(template: str, **values: str) -> str:
    for name, value in values.items():
        template = f"replace({template}, '{{{name}}}', CAST({value} AS VARCHAR))"
    return template


def skewed_project(key: str, n: int, prefix: str = "p") -> str:
    return f"'{prefix}' || CAST(CASE WHEN ({key}) % 3 = 0 THEN 0 ELSE ({key}) % {n} END AS VARCHAR)"


def contains_any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(n)})" for n in needles) + ")"


def starts_with_any(column: str, needles) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {text(n)})" for n in needles) + ")"


def ends_with_any(column: str, needles) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {text(n)})" for n in needles) + ")"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text(pattern)})"


def case_table(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {text(k) if isinstance(k, str) else k} THEN {text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


TRIM_CHARS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def trim(column: str) -> str:
    return f"trim({column}, {TRIM_CHARS})"


def cut(column: str, limit: int) -> str:
    return f"CASE WHEN strlen({column}) > {limit} THEN left({column}, {limit}) || '…' ELSE {column} END"


def define(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(query: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{name} AS MATERIALIZED (\n{CTES[name][1].strip()}\n)" for name in order)
    return f"WITH {head}\n{query.strip()}"


# --- logs -------------------------------------------------------------------

define(
    "event_keys",
    "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events",
)
_MSG = fill(pick(c.LOG_MESSAGES, "event_id"), k="k", u="user_id") + " || ' during ' || event_type"
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
define(
    "log_values",
    f"""
SELECT {skewed_project('user_id', 17)} AS project, event_id, ts, k,
  CASE
    WHEN event_id % 5 < 2 THEN {pick(c.DASHED_LEVELS, 'event_id // 5')} || ' - ' || {_STAMP} || ' --> ' || {_MSG}
    WHEN event_id % 5 < 4 THEN '[' || {_STAMP} || '] production.' || {pick(c.BRACKETED_LEVELS, 'event_id // 5')} || ': ' || {_MSG}
    WHEN (event_id // 5) % 4 = 0 THEN 'PHP Fatal error: ' || {_MSG}
    WHEN (event_id // 5) % 4 = 1 THEN '   '
    WHEN (event_id // 5) % 4 = 2 THEN {_MSG} || ' exception thrown'
    ELSE 'started worker ' || k
  END AS v
FROM event_keys
""",
    "event_keys",
)
define(
    "log_lines",
    """
SELECT project, project || '/app-' || (event_id % 5) || '.log' AS source_file, event_id AS line_order, ts,
  CASE WHEN event_id % 13 = 0 THEN '  ' || v || ' ' || chr(13) ELSE v END AS value
FROM log_values
""",
    "log_values",
)
define(
    "log_trimmed",
    f"SELECT project, source_file, line_order, ts AS event_ts, {trim('value')} AS line FROM log_lines WHERE {trim('value')} <> ''",
    "log_lines",
)
_D, _B, _G = text(logtext.DASHED_LINE), text(logtext.BRACKETED_LINE), text(logtext.LEVEL_WORD)
define(
    "log_parsed",
    f"""
SELECT project, source_file, line_order, event_ts, line,
  CASE WHEN regexp_matches(line, {_D}) THEN upper(regexp_extract(line, {_D}, 1))
       WHEN regexp_matches(line, {_B}) THEN upper(regexp_extract(line, {_B}, 2))
       WHEN regexp_matches(line, {_G}) THEN upper(regexp_extract(line, {_G}, 1)) END AS level,
  CASE WHEN regexp_matches(line, {_D}) THEN regexp_extract(line, {_D}, 2)
       WHEN regexp_matches(line, {_B}) THEN regexp_extract(line, {_B}, 1)
       WHEN regexp_matches(line, {_G}) THEN '' END AS ts,
  CASE WHEN regexp_matches(line, {_D}) THEN {trim(f'regexp_extract(line, {_D}, 3)')}
       WHEN regexp_matches(line, {_B}) THEN {trim(f'regexp_extract(line, {_B}, 3)')}
       WHEN regexp_matches(line, {_G}) THEN line END AS message
FROM log_trimmed
""",
    "log_trimmed",
)
_SIG = (
    "trim(lower(regexp_replace(regexp_replace(regexp_replace(message, '''[^'']*''|\"[^\"]*\"', '?', 'g'), "
    r"'\b[0-9a-fA-Fx]*[0-9][0-9a-fA-Fx]*\b', '#', 'g'), '\s+', ' ', 'g')))"
)
_CATEGORY = "CASE " + " ".join(
    f"WHEN {contains_any('lower(message)', words)} THEN {text(name)}" for name, words in logtext.CATEGORY_WORDS.items()
) + " ELSE 'Application' END"


def _has(*words: str) -> str:
    return contains_any("lower(message)", words)


CAUSE = f"""CASE
  WHEN {_has('deadlock')} THEN {text(logtext.CAUSES['deadlock'])}
  WHEN {_has('lock wait', '1205')} THEN {text(logtext.CAUSES['lock_wait'])}
  WHEN {_has('too many connections')} THEN {text(logtext.CAUSES['connections'])}
  WHEN {_has('2002', 'connection refused')} THEN {text(logtext.CAUSES['unreachable'])}
  WHEN {_has('timeout')} AND {_has('query', 'sql')} THEN {text(logtext.CAUSES['slow_query'])}
  WHEN {_has('allowed memory size', 'out of memory')} THEN {text(logtext.CAUSES['memory'])}
  WHEN {_has('maximum execution time')} THEN {text(logtext.CAUSES['run_time'])}
  WHEN {_has('curl', '504', 'connection timed out')} THEN {text(logtext.CAUSES['upstream'])}
  ELSE '' END"""
LEVEL_RANK = (
    "CASE WHEN level IN ('EMERGENCY','ALERT','CRITICAL','FATAL') THEN 4 "
    "WHEN level IN ('ERROR','EXCEPTION') THEN 3 WHEN level = 'WARNING' THEN 2 ELSE 1 END"
)
define(
    "log_errors",
    f"""
SELECT *, {_SIG} AS signature, {_CATEGORY} AS category, {CAUSE} AS cause, {LEVEL_RANK} AS level_rank
FROM log_parsed
WHERE level IN ({', '.join(text(v) for v in logtext.ERROR_LEVELS)})
""",
    "log_parsed",
)


def log_groups(by: str = "") -> str:
    keys = f"{by}, signature" if by else "signature"
    return f"""
SELECT {keys}, {cut('arg_min(message, line_order)', 200)} AS sample,
  arg_min(category, line_order) AS category,
  arg_max(level, level_rank * 1000000000000 - line_order) AS level,
  count(*) AS count,
  coalesce(min(nullif(ts, '')), '') AS first_seen,
  coalesce(max(nullif(ts, '')), '') AS last_seen,
  arg_min(cause, line_order) AS cause
FROM log_errors GROUP BY {keys}
"""


define("log_groups", log_groups(), "log_errors")
define("log_groups_by_project", log_groups("project"), "log_errors")

# --- runtime events ---------------------------------------------------------

_RT_STAMP = "'\"timestamp\": \"' || strftime(ts, '%Y-%m-%dT%H:%M') || ':00+00:00\", '"
_RT_TYPE = f"'\"type\": \"' || {pick(c.RUNTIME_TYPES, 'event_id')} || '\", '"
_RT_MSG = f"'\"message\": \"' || {fill(pick(c.RUNTIME_MESSAGES, 'event_id // 4'), k='k', u='user_id')} || '\", '"
_RT_FILE = "'\"file\": \"app/M' || (user_id % 4) || '.php\", '"
_RT_TAIL = f"'\"trace\": \"\", \"url\": \"/u\", \"severity\": \"' || {pick(c.RUNTIME_SEVERITIES, 'event_id // 3')} || '\", \"app\": null, '"
_RT_LINE = "'\"line\": ' || (k % 10) || '}'"
define(
    "runtime_json",
    f"""
SELECT {skewed_project('user_id', 17)} AS project, event_id AS event_order,
  CASE
    WHEN event_id % 97 = 5 THEN 'not json ' || event_id
    WHEN event_id % 89 = 7 THEN '{{' || {_RT_STAMP} || {_RT_TYPE} || {_RT_MSG} || {_RT_FILE} || {_RT_TAIL} || '"line": "' || k || '"}}'
    WHEN event_id % 83 = 3 THEN '{{' || {_RT_TYPE} || {_RT_MSG} || {_RT_FILE} || {_RT_TAIL} || {_RT_LINE}
    WHEN event_id % 79 = 2 THEN '{{' || {_RT_STAMP} || '"type": 5, ' || {_RT_MSG} || {_RT_FILE} || {_RT_TAIL} || {_RT_LINE}
    ELSE '{{' || {_RT_STAMP} || {_RT_TYPE} || {_RT_MSG} || {_RT_FILE} || {_RT_TAIL} || {_RT_LINE}
  END AS value
FROM event_keys
""",
    "event_keys",
)
define(
    "runtime_events",
    """
SELECT project, event_order,
  coalesce(json_extract_string(value, '$.timestamp'), '') AS timestamp,
  coalesce(json_extract_string(value, '$.type'), '') AS type,
  coalesce(json_extract_string(value, '$.message'), '') AS message,
  coalesce(json_extract_string(value, '$.file'), '') AS file,
  CAST(coalesce(json_extract_string(value, '$.line'), '0') AS BIGINT) AS line,
  coalesce(json_extract_string(value, '$.severity'), '') AS severity
FROM (SELECT * FROM runtime_json WHERE json_valid(value))
WHERE coalesce(json_type(value, '$.line'), 'NULL') IN ('UBIGINT', 'BIGINT', 'NULL')
  AND coalesce(json_type(value, '$.type'), 'NULL') IN ('VARCHAR', 'NULL')
""",
    "runtime_json",
)


def runtime_groups(by: str = "") -> str:
    keys = f"{by}, type, file, line" if by else "type, file, line"
    return f"""
SELECT {keys}, max(n) AS count, max(timestamp) AS last_seen, max(message) AS last_message, max(severity) AS severity
FROM (
  SELECT *, count(*) OVER (PARTITION BY {keys}) AS n,
    row_number() OVER (PARTITION BY {keys} ORDER BY timestamp DESC, event_order DESC) AS age
  FROM runtime_events)
WHERE age = 1 GROUP BY {keys}
"""


define("runtime_groups", runtime_groups(), "runtime_events")
define("runtime_groups_by_project", runtime_groups("project"), "runtime_events")

# --- files ------------------------------------------------------------------

_O_LINES = (
    f"list_transform(generate_series(1, o_orderkey % 9 + 6), lambda i: "
    f"{pick(c.SOURCE_LINES, 'o_orderkey * 7 + i * 13 + (o_orderkey // 16) * i')})"
)
_MODULE = "'m' || (o_orderkey // 97) || '/'"
define(
    "source_files",
    f"""
SELECT {skewed_project('o_orderkey // 97', 41)} AS project,
  CASE WHEN o_orderkey % 97 = 0 AND (o_orderkey // 97) % 2 = 0 THEN {_MODULE} || 'system/core/CodeIgniter.php'
       ELSE CASE WHEN contains({pick(c.DIRS, 'o_orderkey')}, 'ystem/') THEN {_MODULE} ELSE '' END
         || {pick(c.DIRS, 'o_orderkey')} || {pick(c.NAMES, 'o_orderkey // 3')} || '_' || o_orderkey || {pick(c.EXTS, 'o_orderkey // 7')}
  END AS path,
  CASE WHEN o_orderkey % 401 = 0 THEN 3000000 ELSE strlen(content) END AS size,
  content
FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS content
  FROM (SELECT o_orderkey, array_to_string({_O_LINES}, chr(10)) AS text FROM orders))
""",
)
_P_LINES = (
    f"list_transform(generate_series(1, p_partkey % 8 + 5), lambda i: "
    f"{pick(c.CONFIG_LINES, 'p_partkey * 5 + i * 11 + (p_partkey // 13) * i')})"
)
define(
    "config_corpus",
    f"""
SELECT project, path, CASE WHEN p_partkey % 211 = 0 THEN 600000 ELSE strlen(content) END AS size, content
FROM (
  SELECT p_partkey, {skewed_project('p_partkey', 29)} AS project,
    'svc' || p_partkey || '/' || {pick(c.CONFIG_NAMES, 'p_partkey')} AS path,
    CASE WHEN {pick(c.CONFIG_NAMES, 'p_partkey')} = 'pod.yaml' THEN 'apiVersion: v1' || chr(10) || 'kind: Pod' || chr(10) ELSE '' END
      || array_to_string({_P_LINES}, chr(10)) AS content
  FROM part)
""",
)


def basename(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def extension(path: str) -> str:
    base = basename(path)
    return f"CASE WHEN contains({base}, '.') THEN lower('.' || string_split({base}, '.')[-1]) ELSE '' END"


def dirs(path: str) -> str:
    return f"string_split({path}, '/')[:-2]"


def in_ignored(path: str) -> str:
    return f"list_has_any({dirs(path)}, {items(fp.IGNORED_DIRS)})"


def in_vendored(path: str) -> str:
    lowered = f"list_transform({dirs(path)}, lambda d: lower(d))"
    return f"({in_ignored(path)} OR list_has_any({lowered}, {items(fp.VENDORED_DIRS)}))"


MINIFIED = ends_with_any(f"lower({basename('path')})", (".min.js", ".bundle.js", "-min.js"))
SOURCE = f"({extension('path')}) IN ({', '.join(text(e) for e in fp.SOURCE_EXTS)})"

_LOW = "'/' || lower(path)"
_BASE = f"lower({basename('path')})"
ROLE = f"""CASE
  WHEN contains({_BASE}, 'test') THEN 'Tests'
  WHEN contains({_BASE}, 'controller') THEN 'Controllers'
  WHEN contains({_BASE}, 'service') THEN 'Services'
  WHEN contains({_BASE}, 'model') THEN 'Models'
  WHEN contains({_BASE}, 'migration') THEN 'Migrations'
  WHEN {contains_any(_LOW, ('/tests/', '/test/'))} THEN 'Tests'
  WHEN {contains_any(_LOW, ('/controllers/', '/controller/'))} THEN 'Controllers'
  WHEN {contains_any(_LOW, ('/services/', '/service/'))} THEN 'Services'
  WHEN {contains_any(_LOW, ('/models/', '/model/'))} THEN 'Models'
  WHEN {contains_any(_LOW, ('/views/', '/view/'))} OR {ends_with_any(_BASE, ('.blade.php', '.twig'))} THEN 'Views'
  WHEN contains({_LOW}, 'migration') THEN 'Migrations'
  WHEN contains({_LOW}, '/config/') OR {_BASE} = 'config.php' OR ends_with({_BASE}, '.env') THEN 'Config' END"""
BENIGN = (
    "(" + starts_with_any("lower(path)", ("lang/", "tests/", "test/"))
    + " OR " + contains_any("lower(path)", ("/lang/", "/translations/", "/locale/", "/locales/", "/tests/", "/test/",
                                             "/seeders/", "/seeds/", "/factories/", ".example."))
    + " OR " + ends_with_any("lower(path)", ("_test.go", ".test.js", ".test.ts", ".spec.js", ".spec.ts", ".example",
                                             ".dist", ".sample", ".blade.php", ".twig", ".vue", ".html", ".htm")) + ")"
)

define(
    "core_dirs",
    """
SELECT DISTINCT project, left(path, length(path) - length('/core/CodeIgniter.php')) AS core_dir
FROM source_files WHERE regexp_matches(path, '(^|/)(?i:system)/core/CodeIgniter\\.php$')
""",
    "source_files",
)
define(
    "analysed_files",
    f"""
SELECT * FROM source_files f
WHERE NOT {in_vendored('path')}
  AND NOT EXISTS (SELECT 1 FROM core_dirs d WHERE d.project = f.project AND starts_with(f.path, d.core_dir || '/'))
""",
    "source_files",
    "core_dirs",
)
define(
    "code_files",
    f"SELECT * FROM analysed_files WHERE NOT {MINIFIED} AND {SOURCE} AND {basename('path')} NOT IN ('composer.json', 'package.json')",
    "analysed_files",
)
define(
    "raw_lines",
    f"""
SELECT project, path, ext, u.n AS line_no, u.t AS line
FROM (
  SELECT project, path, {extension('path')} AS ext,
    list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda t, i: {{'n': i, 't': t}}) AS ls
  FROM code_files), unnest(ls) AS x(u)
""",
    "code_files",
)
_AFTER_LAST_OPEN = "'*' || string_split(line, '/*')[-1]"
define(
    "line_kinds",
    f"""
SELECT *, {trim('line')} AS t,
  CASE WHEN contains(line, '/*') AND NOT contains({_AFTER_LAST_OPEN}, '*/')
       THEN CASE WHEN contains(line, '*/') THEN 2 ELSE 1 END
       ELSE CASE WHEN contains(line, '*/') THEN 0 ELSE 3 END END AS kind
FROM raw_lines
""",
    "raw_lines",
)
define(
    "line_swaps",
    """
SELECT *, sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY project, path ORDER BY line_no) AS swaps
FROM line_kinds
""",
    "line_kinds",
)
define(
    "line_states",
    """
SELECT *,
  coalesce(max(CASE WHEN kind < 2 THEN line_no * 100000 + swaps * 10 + kind END) OVER w, 0) AS last_set,
  coalesce(max(swaps) OVER w, 0) AS swaps_before
FROM line_swaps
WINDOW w AS (PARTITION BY project, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
    "line_swaps",
)
_IS_COMMENT_T = starts_with_any("t", ("//", "#", "*", "/*", "<!--"))
define(
    "masked_lines",
    f"""
SELECT project, path, ext, line_no, line, t,
  (last_set % 10 + swaps_before - (last_set // 10) % 10000) % 2 = 1 AS in_block,
  first_value(CASE WHEN t <> '' AND NOT {_IS_COMMENT_T} THEN t END IGNORE NULLS)
    OVER (PARTITION BY project, path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_code
FROM line_states
""",
    "line_states",
)
_MASKED = starts_with_any("t", ("//", "/*", "*", "<!--"))
_LIT = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`"""
_NS = rf"""(?:[^'"`/]|{_LIT})"""
_NH = rf"""(?:[^'"`/#]|{_LIT})"""
_NP = rf"""(?:[^'"`/#]|#\[|{_LIT})"""


def _strip(item: str, hashes: bool, after: str = ".*") -> str:
    """Where a trailing comment starts, as patterns that need no look-ahead."""
    body = f"(?:{item}|/{item})*"
    slashes = rf"(?s)^({body})//.*$"
    if not hashes:
        return f"CASE WHEN {matches('line', slashes)} THEN regexp_extract(line, {text(slashes)}, 1) ELSE line END"
    marks = rf"(?s)^({body}/?)#{after}$"
    return (
        f"CASE WHEN {matches('line', slashes)} THEN regexp_extract(line, {text(slashes)}, 1) "
        f"WHEN {matches('line', marks)} THEN regexp_extract(line, {text(marks)}, 1) ELSE line END"
    )


define(
    "code_lines",
    f"""
SELECT *, lower(line) AS lower, 
  NOT in_block AND t <> '' AND NOT {_MASKED} AND NOT (ext IN ('.php', '.py', '.rb') AND starts_with(t, '#')) AS is_code,
  CASE WHEN ext = '.php' THEN {_strip(_NP, True, r"(?:[^\[].*)?")}
       WHEN ext IN ('.py', '.rb') THEN {_strip(_NH, True)}
       ELSE {_strip(_NS, False)} END AS stripped
FROM masked_lines
""",
    "masked_lines",
)
define(
    "rule_lines",
    f"""
SELECT *, lower(code) AS code_lower, {starts_with_any(trim('code'), ('//', '#', '*', '/*', '<!--'))} AS code_comment
FROM (SELECT *, CASE WHEN is_code THEN CASE WHEN stripped = line THEN line ELSE rtrim(stripped, ' ' || chr(9)) END ELSE '' END AS code,
        {BENIGN} AS benign FROM code_lines)
""",
    "code_lines",
)

_VALUE = f"regexp_extract(line, {text(rb.CREDENTIAL_RULE.pattern)}, 2)"


def token_condition(rule: rb.Rule) -> str:
    extra = " AND NOT benign" if rule.number == rb.PEM_RULE_NUMBER else ""
    return f"({contains_any('lower', rule.gates)} AND {matches('line', rule.pattern)}{extra})"


def placeholder(value: str) -> str:
    v = f"lower({trim(value)})"
    return (
        f"(strlen({v}) < 4 OR regexp_matches({v}, '[ \\t\\n]') OR starts_with({v}, '$') "
        f"OR {v} IN ({', '.join(text(w) for w in rb.PLACEHOLDER_WORDS)}) OR {contains_any(v, rb.PLACEHOLDER_PARTS)})"
    )


def rule_condition(rule: rb.Rule) -> str:
    if rule.rule_id == "SEC_TOKEN":
        return token_condition(rule)
    if rule.rule_id == "SEC_HARDCODED_CREDENTIAL":
        tokens = " OR ".join(token_condition(r) for r in rb.TOKEN_RULES)
        return (
            f"NOT benign AND NOT ({tokens}) AND {contains_any('lower', rule.gates)} "
            f"AND {matches('line', rule.pattern)} AND NOT {placeholder(_VALUE)}"
        )
    exts = f"ext IN ({', '.join(text(e) for e in rule.exts)}) AND " if rule.exts else ""
    if rule.rule_id == "ERR_EMPTY_CATCH":
        rest = trim(r"regexp_extract(line, '^[^{]*\{(.*)$', 1)")
        return (
            f"{exts}is_code AND {matches('line', rule.pattern)} AND contains(line, '{{') "
            f"AND ({rest} = '}}' OR ({rest} = '' AND coalesce(next_code, '') = '}}'))"
        )
    gate = contains_any("code_lower", rule.gates)
    if rule.rule_id == "DB_RAW_SQL_CONCAT":
        body = f"contains(code, '$') AND {matches('code', rb.SQL_VERB)} AND {matches('code', rb.SQL_CLAUSE)} AND {matches('code', rb.SQL_CONCAT)}"
    elif rule.rule_id == "NPE_NULLABLE_CHAIN":
        body = f"contains(code, '->') AND {matches('code', rule.pattern)}"
    elif rule.rule_id == "XSS_REFLECTED":
        body = f"{matches('code', rule.pattern)} AND NOT {matches('code', rb.XSS_ESCAPED)}"
    else:
        body = f"NOT code_comment AND {matches('code', rule.pattern)}"
    return f"{exts}is_code AND {gate} AND {body}"


def rule_query(rule: rb.Rule) -> str:
    shown = "line" if rule.number <= 5 or rule.number == 60 else "code"
    return f"""
SELECT project, path AS file, CAST(line_no AS INTEGER) AS line, {text(rule.severity)} AS severity, {cut(trim(shown), 160)} AS snippet
FROM rule_lines WHERE {rule_condition(rule)}
"""


def _union(rules, query) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {text(r.rule_id)} AS rule_id, {text(r.category)} AS category, {text(r.title)} AS title, q.* FROM ({query(r).strip()}) q"
        for r in rules
    )


define("code_found", _union(rb.CODE_RULES, rule_query), "rule_lines")

_YAML = ends_with_any("base", (".yml", ".yaml"))
KIND = f"""CASE
  WHEN base = 'dockerfile' OR starts_with(base, 'dockerfile.') OR ends_with(base, '.dockerfile') THEN 'dockerfile'
  WHEN base IN ('compose.yml', 'compose.yaml') OR (starts_with(base, 'docker-compose') AND {_YAML}) THEN 'compose'
  WHEN starts_with(base, '.env') THEN CASE WHEN {contains_any('base', ('example', 'sample', 'dist', 'template'))} THEN NULL ELSE 'env' END
  WHEN base IN ('nginx.conf', '.htaccess', 'httpd.conf', 'apache2.conf') THEN 'webserver'
  WHEN {_YAML} AND contains(content, 'apiVersion:') AND contains(content, 'kind:') THEN 'k8s' END"""


def kinds_of(source: str) -> str:
    return f"""
SELECT * FROM (SELECT *, {KIND} AS kind FROM (SELECT *, lower({basename('path')}) AS base FROM {source}))
WHERE kind IS NOT NULL
"""


define("config_kinds", kinds_of("config_corpus"), "config_corpus")
define(
    "config_lines",
    f"""
SELECT project, path, kind, u.n AS line_no, u.t AS line, lower(u.t) AS low
FROM (SELECT project, path, kind, list_transform(string_split(content, chr(10)), lambda t, i: {{'n': i, 't': t}}) AS ls FROM config_kinds),
  unnest(ls) AS x(u)
WHERE {trim('u.t')} <> '' AND NOT starts_with({trim('u.t')}, '#')
""",
    "config_kinds",
)
_AFTER_EQUALS = trim("substr(line, instr(line, '=') + 1)")
_ENV_VALUE = f"trim({_AFTER_EQUALS}, chr(34) || chr(39))"


def config_condition(rule: rb.Rule) -> str:
    extra = ""
    if rule.rule_id == "COMPOSE_DB_PORT_EXPOSED":
        extra = " AND NOT (contains(low, '127.0.0.1') OR contains(low, 'localhost'))"
    if rule.rule_id == "ENV_SECRET_COMMITTED":
        v = _ENV_VALUE
        extra = (
            f" AND contains(line, '=') AND {v} <> '' AND NOT {starts_with_any(v, ('${', '$(', '<'))}"
            f" AND NOT {contains_any(f'lower({v})', rb.ENV_PLACEHOLDER_PARTS)}"
        )
    return f"kind = '{rule.kind}' AND {contains_any('low', rule.gates)} AND {matches('line', rule.pattern)}{extra}"


def config_query(rule: rb.Rule) -> str:
    return f"""
SELECT project, path AS file, CAST(line_no AS INTEGER) AS line, {text(rule.severity)} AS severity, {cut(trim('line'), 160)} AS snippet
FROM config_lines WHERE {config_condition(rule)}
"""


define("config_found", _union(rb.CONFIG_RULES, config_query), "config_lines")

# --- findings and their companions -------------------------------------------

_FI = "(l_orderkey + l_linenumber * 5 + l_partkey)"
define(
    "findings",
    f"""
SELECT *, CASE WHEN own THEN 'CWE-250' ELSE '' END AS cwe, CASE WHEN own THEN 'A05:2021 Security Misconfiguration' ELSE '' END AS owasp,
  {case_table('severity', {'Critical': 4, 'High': 3, 'Medium': 2, 'Low': 1}, '0')} AS rank,
  category IN ('Security', 'Database', 'Dependencies', 'Configuration', 'Infrastructure') AS is_sec
FROM (
  SELECT *, starts_with(rule_id, 'DOCKER_') OR starts_with(rule_id, 'SEMGREP:') AS own FROM (
    SELECT {skewed_project('l_orderkey', 23)} AS project,
      {pick(c.FINDING_RULES, _FI)} AS rule_id,
      {pick(c.FINDING_SEVERITIES, _FI + ' + l_suppkey % 3')} AS severity,
      {pick(c.FINDING_CATEGORIES, _FI)} AS category,
      'Title ' || ({_FI} % {len(c.FINDING_RULES)}) AS title,
      'src/f' || (l_partkey % 60) || '.php' AS file,
      CAST((l_linenumber * 10 + l_suppkey % 7) * (l_orderkey % 5) AS INTEGER) AS line,
      CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'code ' || (l_suppkey % 50) END AS snippet,
      'Why ' || (l_partkey % 3) AS explanation,
      CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'Fix it.' END AS recommendation,
      CAST(l_partkey AS INTEGER) AS phase, CAST(l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS INTEGER) AS ord
    FROM lineitem))
""",
)
_META_ROWS = ", ".join(f"({text(k)}, {text(a)}, {text(b)})" for k, (a, b) in rb.RULE_META.items())
define("rule_meta", f"SELECT * FROM (VALUES {_META_ROWS}) AS m(rule_id, meta_cwe, meta_owasp)")
define(
    "enriched",
    """
SELECT f.* REPLACE (
    coalesce(nullif(f.cwe, ''), m.meta_cwe, '') AS cwe,
    coalesce(nullif(f.owasp, ''), m.meta_owasp, '') AS owasp)
FROM findings f LEFT JOIN rule_meta m USING (rule_id)
""",
    "findings",
    "rule_meta",
)
FINGERPRINT = "sha1(rule_id || '|' || file || '|' || CASE WHEN snippet <> '' THEN snippet ELSE title END)"
ORDER = "rank DESC, file, line, phase, ord"
define(
    "scanned",
    "SELECT project, count(DISTINCT file) AS files_scanned FROM findings GROUP BY project",
    "findings",
)

_DT = f"CASE WHEN o_orderkey % 19 = 0 THEN '+++ /dev/null' ELSE CASE WHEN o_orderkey % 7 = 0 THEN '+++ b/./src/f' ELSE '+++ b/src/f' END || (o_custkey % 60) || '.php' END"
define(
    "diff_lines",
    f"""
SELECT project, o * 10 + u.i AS line_no, u.t AS text FROM (
  SELECT {skewed_project('o_orderkey', 23)} AS project, o_orderkey AS o, [
    {{'i': 0, 't': 'diff --git a/x b/x'}}, {{'i': 1, 't': '--- a/x'}},
    {{'i': 2, 't': CASE WHEN o_orderkey % 2 = 0 THEN {_DT} ELSE ' context' END}},
    {{'i': 3, 't': '@@ -1,2 +' || (o_orderkey % 40 * 5 + 1) || ',' || (o_orderkey % 4) || ' @@ fn()'}},
    {{'i': 4, 't': '+added'}}, {{'i': 5, 't': '@@ -20 +' || (o_orderkey % 90) || ' @@'}},
    {{'i': 6, 't': '@@ broken'}}, {{'i': 7, 't': '@@ -5,2 +' || (o_orderkey % 40 * 5 + 1) || ',0 @@'}}] AS ls
  FROM orders), unnest(ls) AS x(u)
""",
)
define(
    "diff_tagged",
    r"""
SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY project ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS file
FROM (
  SELECT *, CASE WHEN starts_with(text, '+++ ') THEN
      CASE WHEN substr(text, 5) = '/dev/null' THEN '' ELSE regexp_replace(regexp_replace(substr(text, 5), '^b/', ''), '^\./', '') END END AS header
  FROM diff_lines WHERE starts_with(text, '+++ ') OR starts_with(text, '@@'))
""",
    "diff_lines",
)
_HUNK = r"'^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@'"
define(
    "diff_ranges",
    f"""
SELECT project, file, s AS start, s + n - 1 AS "end" FROM (
  SELECT project, file, CAST(regexp_extract(text, {_HUNK}, 1) AS INTEGER) AS s,
    CAST(CASE WHEN regexp_extract(text, {_HUNK}, 2) = '' THEN '1' ELSE regexp_extract(text, {_HUNK}, 2) END AS INTEGER) AS n
  FROM diff_tagged WHERE coalesce(file, '') <> '' AND regexp_matches(text, {_HUNK}))
WHERE n > 0
""",
    "diff_tagged",
)
define(
    "diff_files",
    "SELECT DISTINCT project, file FROM diff_tagged WHERE header IS NOT NULL AND file <> ''",
    "diff_tagged",
)
define(
    "scan_history",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS id, path AS project, path, created_at, total, score AS security_score,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS security_grade
FROM (SELECT *, '/srv/c' || CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS path,
  strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS created_at,
  CAST(floor(o_totalprice / 5000) AS BIGINT) AS total, CAST(o_orderkey % 101 AS INTEGER) AS score FROM orders)
""",
)
define(
    "deps",
    f"""
SELECT {skewed_project('l_orderkey', 23)} AS project, 'composer.lock' AS source, {pick(c.ECOSYSTEMS, 'l_partkey')} AS ecosystem,
  'pkg-' || l_partkey AS name, (l_suppkey % 4) || '.' || (l_linenumber % 3) || '.0' AS version
FROM lineitem
""",
)
define(
    "advisories",
    f"""
SELECT 'ADV-' || p_partkey AS id, {pick(c.ECOSYSTEMS, 'p_partkey')} AS ecosystem, 'pkg-' || p_partkey AS name,
  (p_size % 4) || '.' || (p_partkey % 3) || '.0' AS version, {pick(c.ADVISORY_SEVERITIES, 'p_size')} AS severity,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS summary
FROM part
""",
)
for _engine, _template in c.REPORT_TEMPLATES.items():
    _filled = fill(
        text(_template), n="c_custkey", d="c_custkey % 10",
        s=pick(c.REPORT_SEVERITIES, "c_custkey"), c=pick(c.REPORT_CATEGORIES, "c_custkey"),
    )
    define(f"{_engine}_reports", f"SELECT 'c' || c_custkey AS project, {_filled} AS payload FROM customer")

define(
    "file_paths",
    f"""
SELECT project, path FROM source_files
UNION ALL
SELECT {skewed_project('page_id', 41)} AS project, regexp_replace(url, '^https?://', '') || {pick(c.EXTS, 'page_id')} AS path FROM pages
""",
    "source_files",
)
define("walked_paths", f"SELECT * FROM file_paths WHERE NOT {in_ignored('path')}", "file_paths")


def _entry(condition: str, path: str, content: str) -> str:
    return f"CASE WHEN {condition} THEN {{'path': {text(path)}, 'content': {content}}} END"


_K = "c_custkey"
_N = "c_custkey % 7"
_MANIFESTS = [
    _entry(f"{_K} % 3 = 0", "composer.json", pick(c.COMPOSER, _K)),
    _entry(f"{_K} % 5 = 2", "api/composer.json", pick(c.COMPOSER, f"{_K} + 1")),
    _entry(f"{_K} % 4 <= 1", "package.json", pick(c.PACKAGE, f"{_K} // 4")),
    _entry(f"{_K} % 5 = 0", "requirements.txt", fill(pick(c.REQUIREMENTS, f"{_K} // 5"), n=_N)),
    _entry(f"{_K} % 10 = 0", "pyproject.toml", "'dependencies = [\"Django\"]'"),
    _entry(f"{_K} % 7 = 0", "docker-compose.yml", pick(c.COMPOSE, f"{_K} // 7")),
    _entry(f"{_K} % 2 = 0", "Dockerfile", "'FROM scratch'"),
    _entry(f"{_K} % 6 = 1", ".env", pick(c.ENVS, f"{_K} // 6")),
    _entry(f"{_K} % 8 = 3", "application/config/database.php", pick(c.DATABASE_PHP, f"{_K} // 8")),
    _entry(f"{_K} % 9 = 4", "k8s/deploy.yaml", text(c.K8S_YAML)),
    _entry(f"{_K} % 9 = 5", "deploy/b.yaml", text(c.K8S_YAML)),
    _entry(f"{_K} % 9 = 5", "deploy/a.yml", "'kind: none'"),
    _entry(f"{_K} % 10 = 6", "infra/main.tf", "'provider \"aws\" {}'"),
    _entry(f"{_K} % 11 = 2", "system/core/CodeIgniter.php", fill(pick(c.CORE_PHP, f"{_K} // 11"), n=_N)),
    _entry(f"{_K} % 13 = 3", "artisan", "''"),
    _entry(f"{_K} % 13 = 5", "spark", "''"),
    _entry(f"{_K} % 13 = 7", "manage.py", "'import django'"),
    _entry(f"{_K} % 13 = 9", "go.mod", "'module x' || chr(10)"),
    _entry(f"{_K} % 13 = 11", "pom.xml", "'<a>spring-boot</a>'"),
    _entry(f"{_K} % 17 = 1", "serverless.yml", "'service: x'"),
    _entry(f"{_K} % 19 = 1", ".aws/config", "''"),
    _entry(f"{_K} % 3 = 1", "composer.lock", fill(text(c.LOCK), n=_N)),
    _entry(f"{_K} % 2 = 1", "src/index.js", "''"),
    _entry(f"{_K} % 4 = 1", "src/app.py", "''"),
    _entry(f"{_K} % 4 = 3", "vendor/x/package.json", pick(c.PACKAGE, _K)),
]
define(
    "manifest_files",
    f"""
SELECT 'c' || c_custkey AS project, u.path AS path, u.content AS content, strlen(u.content) AS size
FROM (SELECT c_custkey, [{', '.join(_MANIFESTS)}] AS fs FROM customer), unnest(fs) AS x(u) WHERE u IS NOT NULL
""",
)
