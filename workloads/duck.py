"""The same input tables for DuckDB, and helpers to phrase rules in SQL."""

from __future__ import annotations

from sentrymill.fixed_values import rules as R
from sentrymill.operators.ignore import IGNORE_FILE
from workloads import planted
from workloads.views import FAMILIES


def q(text: str) -> str:
    """A SQL string literal."""
    body = text.replace("'", "''")
    return "'" + body.replace("\n", "' || chr(10) || '") + "'" if "\n" in body else f"'{body}'"


def values(rows, columns: str) -> str:
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + f") AS t({columns})"


def pick(texts, index: str) -> str:
    return f"list_extract([{', '.join(q(t) for t in texts)}], {index} + 1)"


_PLANTED = [(f, i, line) for f, ls in FAMILIES.items() for i, line in enumerate(ls)]
_SIZE = "CASE family " + " ".join(f"WHEN '{f}' THEN {len(ls)}" for f, ls in FAMILIES.items()) + " END"
FILES = f"""
planted AS (SELECT * FROM {values(_PLANTED, 'family, idx, line')}),
doc_kind AS (SELECT doc_id, source, text, doc_id % 12 AS kind,
   CASE WHEN doc_id % 12 = 4 THEN 'docker' WHEN doc_id % 12 IN (5, 11) THEN 'iac' WHEN doc_id % 12 = 6 THEN 'ci'
        ELSE 'code' END AS family FROM documents),
dot_first AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source),
files AS (
  SELECT source AS repo,
     CASE kind WHEN 0 THEN 'src/mod_' || doc_id || '.py' WHEN 1 THEN 'web/app_' || doc_id || '.js'
       WHEN 2 THEN 'lib/page_' || doc_id || '.php' WHEN 3 THEN 'core/Main' || doc_id || '.java'
       WHEN 4 THEN 'svc' || doc_id || '/Dockerfile' WHEN 5 THEN 'infra/net_' || doc_id || '.tf'
       WHEN 6 THEN '.github/workflows/ci_' || doc_id || '.yml' WHEN 7 THEN 'examples/demo_' || doc_id || '/config.py'
       WHEN 8 THEN 'certs/server_' || doc_id || '.pem' WHEN 9 THEN 'conf_' || doc_id || '/.env'
       WHEN 10 THEN 'keys_' || doc_id || '/id_rsa' ELSE 'stack_' || doc_id || '/docker-compose.yml' END AS path,
     text || chr(10) || line AS content
  FROM doc_kind JOIN planted p ON p.family = doc_kind.family AND p.idx = (doc_id // 12 + kind * 13) % ({_SIZE.replace('family', 'doc_kind.family')})
  UNION ALL
  SELECT source, '{IGNORE_FILE}', {pick(planted.IGNORE_FILES, f'first % {len(planted.IGNORE_FILES)}')} FROM dot_first
  UNION ALL
  SELECT source, '.gitignore', {pick(planted.GITIGNORES, f'first % {len(planted.GITIGNORES)}')} FROM dot_first)
"""

FILE_KINDS = r"""
kinds AS (SELECT repo, path, content, CASE
     WHEN regexp_matches(path, '(?i)(^|/)[^/]+\.(py|js|ts|jsx|tsx|php|rb|java|go)$') THEN 'code'
     WHEN regexp_matches(path, '(?i)(^|/)(dockerfile|dockerfile\.[^/]*|[^/]*\.dockerfile)$') THEN 'dockerfile'
     WHEN regexp_matches(path, '(?i)(^|/)([^/]+\.(tf|tfvars)|(docker-)?compose\.ya?ml)$') THEN 'iac'
     WHEN regexp_matches(path, '^\.github/workflows/.+\.(?i:ya?ml)$') THEN 'workflow' END AS file_kind
   FROM files WHERE NOT regexp_matches(path, '(^|/)(\.git|node_modules|__pycache__|\.venv|venv|dist|build)/'))
"""


def lines_of(source: str, columns: str = "repo, path", where: str = "true") -> str:
    """Lines of a table with a content column (the test data breaks lines with \\n only)."""
    return (f"(SELECT {columns}, unnest(arr) AS line, generate_subscripts(arr, 1)::INT AS line_no FROM "
            f"(SELECT {columns}, string_split(content, chr(10)) AS arr FROM {source} WHERE {where}))")


# RE2 has no look-ahead: these rules become "matches and does not match"
_SPLIT_RULES = {
    r"(?i)yaml\.load\s*\((?![^)\n]*safe)":
        (r"(?i)yaml\.load\s*\(", r"(?i)yaml\.load\s*\([^)\n]*safe"),
    r"(?i)apt-get install(?!.*--no-install-recommends)":
        (r"(?i)apt-get install", r"(?i)apt-get install.*--no-install-recommends"),
    r"(?i)uses:\s*(?!actions/)[\w.-]+/[\w.-]+@(?:main|master|v?\d+(?:\.\d+)*)\s*$":
        (r"(?i)uses:\s*[\w.-]+/[\w.-]+@(?:main|master|v?\d+(?:\.\d+)*)\s*$", r"(?i)uses:\s*actions/"),
}


def matches(column: str, pattern: str) -> str:
    if pattern in _SPLIT_RULES:
        yes, no = _SPLIT_RULES[pattern]
        return f"(regexp_matches({column}, {q(yes)}) AND NOT regexp_matches({column}, {q(no)}))"
    return f"regexp_matches({column}, {q(pattern)})"


NOSEC_TAIL = r"regexp_extract(line, '(?i)(?:#|//|/\*|<!--)\s*nosec\b([^\n]*)', 1)"
_TOKENS = rf"list_transform(regexp_split_to_array(lower({NOSEC_TAIL}), '[,\s]+'), lambda w: trim(w, ': '))"


def scope_list() -> str:
    parts = [f"CASE WHEN list_has_any({_TOKENS}, [{', '.join(q(a) for a in al)}]) THEN '{s}' END"
             for s, al in R.SUPPRESSION_SCOPES.items()]
    return f"list_filter([{', '.join(parts)}], lambda s: s IS NOT NULL)"


def suppressed(scope: str) -> str:
    return (rf"(regexp_matches(line, '(?i)(?:#|//|/\*|<!--)\s*nosec\b') AND "
            f"(len({scope_list()}) = 0 OR list_contains({scope_list()}, '{scope}')))")


def rule_values(rules) -> str:
    return values([(i, r[0], r[1], r[2], r[4]) for i, r in enumerate(rules)],
                  "rule, issue_type, category, severity, description")




def masked_context(line: str = "line") -> str:
    """A line with every value of a secret rule masked, longest first, then trimmed and cut."""
    from sentrymill.fixed_values.secrets import SECRET_RULES
    found = ", ".join(f"regexp_extract_all({line}, {q(r[3])}, {r[4]})" for r in SECRET_RULES)
    longest = (f"list_reverse_sort(list_transform(list_distinct(list_filter(flatten([{found}]), lambda v: v <> '')), "
               "lambda v: lpad(length(v)::VARCHAR, 6, '0') || v))")
    masked = (f"list_reduce(list_concat([{line}], list_transform({longest}, lambda v: substr(v, 7))), "
              "lambda acc, v: replace(acc, v, left(v, 4) || '****'))")
    return f"substr(trim({masked}, ' ' || chr(9)), 1, 120)"


CONTEXT = masked_context()
FINDING = "repo, path, line_no, issue_type, category, severity, description, context"


def first_match_sql(kind: str, rules, skip_comments: bool) -> str:
    chain = " ".join(f"WHEN {matches('line', r[3])} THEN {i}" for i, r in enumerate(rules))
    comment = r"AND NOT regexp_matches(line, '^\s*#')" if skip_comments else ""
    source = lines_of("kinds", where=f"file_kind = '{kind}'")
    return f"""SELECT repo, path, line_no, issue_type, category, severity, description, {CONTEXT} AS context
      FROM (SELECT *, CASE {chain} END AS rule FROM {source} WHERE true {comment}) m
      JOIN {rule_values(rules)} USING (rule) WHERE NOT {suppressed('code')}"""


def docker_sql() -> str:
    branches = [f"SELECT *, {i} AS rule FROM ls WHERE {matches('line', r[3])}" for i, r in enumerate(R.DOCKER_RULES)]
    name, cat, sev, _, desc, _ = R.DOCKER_ABSENCE_RULE
    return f"""SELECT repo, path, line_no, issue_type, category, severity, description, {CONTEXT} AS context
      FROM (WITH ls AS {lines_of('kinds', where="file_kind = 'dockerfile'")} {' UNION ALL '.join(branches)}) m
      JOIN {rule_values(R.DOCKER_RULES)} USING (rule) WHERE NOT {suppressed('code')}
      UNION ALL SELECT repo, path, 1, {q(name)}, {q(cat)}, {q(sev)}, {q(desc)},
        {masked_context('string_split(content, chr(10))[1]')}
      FROM kinds WHERE file_kind = 'dockerfile' AND NOT regexp_matches(content, '(?im)^\\s*USER\\s+\\S+')"""


CODE_ALL = f"""
code_f AS ({first_match_sql('code', R.CODE_RULES, False)}),
docker_f AS ({docker_sql()}),
iac_f AS ({first_match_sql('iac', R.IAC_RULES, True)}),
ci_f AS ({first_match_sql('workflow', R.WORKFLOW_RULES, True)})
"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + " "


def _filled(template: str) -> str:
    text = q(template)
    for key, value in (("{o}", "l_orderkey"), ("{p}", "l_partkey"), ("{s}", "l_suppkey"), ("{l}", "l_linenumber"),
                       ("{q}", "l_quantity::INT")):
        text = f"replace({text}, '{key}', ({value})::VARCHAR)"
    return text


def _manifests() -> str:
    from workloads import views as v
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(v.MANIFEST_NAMES))
    texts = " ".join(f"WHEN {i} THEN {_filled(t)}" for i, t in enumerate(v.MANIFEST_TEXTS))
    return f"""manifests AS (SELECT 'repo-' || l_suppkey AS repo,
      'o' || l_orderkey || '/svc-' || l_linenumber || '-' || l_partkey || '/' || CASE l_orderkey % 7 {names} END AS file,
      l_orderkey % 7 AS fmt, CASE l_orderkey % 7 {texts} END AS content, row_number() OVER () AS mid FROM lineitem)"""


MANIFESTS = _manifests()
_L = lines_of("manifests", "repo, file, fmt, mid")
PACKAGES = rf"""
mlines AS MATERIALIZED {_L},
pk_req AS (SELECT repo, file, regexp_extract(trim(line), '^([A-Za-z0-9_\-\.]+)\s*[=<>!~^]{{1,2}}\s*([0-9][^\s,;#]*)', 1) AS package,
    regexp_extract(trim(line), '^([A-Za-z0-9_\-\.]+)\s*[=<>!~^]{{1,2}}\s*([0-9][^\s,;#]*)', 2) AS version, 'PyPI' AS ecosystem
  FROM mlines WHERE fmt = 0 AND NOT regexp_matches(trim(line), '^(#|-|git\+|http)')
    AND regexp_matches(trim(line), '^([A-Za-z0-9_\-\.]+)\s*[=<>!~^]{{1,2}}\s*([0-9][^\s,;#]*)')),
pk_npm AS (SELECT repo, file, k AS package, regexp_replace(json_extract_string(content, '$.' || sec || '."' || k || '"'), '^[^0-9]*', '') AS version,
    'npm' AS ecosystem
  FROM (SELECT repo, file, content, sec, unnest(json_keys(content, '$.' || sec)) AS k FROM manifests, (VALUES ('dependencies'), ('devDependencies')) s(sec)
        WHERE fmt = 1) WHERE regexp_replace(json_extract_string(content, '$.' || sec || '."' || k || '"'), '^[^0-9]*', '') <> ''),
go_lines AS (SELECT repo, file, mid, line_no, trim(replace(string_split(line, '//')[1], chr(9), ' ')) AS line FROM mlines WHERE fmt = 2),
go_state AS (SELECT *, last_value(CASE WHEN starts_with(line, 'require') AND contains(line, '(') THEN 1 WHEN line = ')' THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY mid ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM go_lines),
go_kept AS (SELECT repo, file, trim(CASE WHEN starts_with(line, 'require ') THEN substr(line, 9) ELSE line END) AS line FROM go_state
    WHERE line NOT IN ('', ')') AND NOT (starts_with(line, 'require') AND contains(line, '(')) AND (starts_with(line, 'require ') OR open = 1)),
pk_go AS (SELECT repo, file, regexp_extract(line, '^(\S+)\s+v([0-9]\S*)', 1) AS package, regexp_extract(line, '^(\S+)\s+v([0-9]\S*)', 2) AS version,
    'Go' AS ecosystem FROM go_kept WHERE regexp_matches(line, '^(\S+)\s+v([0-9]\S*)')),
pk_gem AS (SELECT repo, file, regexp_extract(line, '^    (\S+) \(([0-9][^)]*)\)\s*$', 1) AS package, regexp_extract(line, '^    (\S+) \(([0-9][^)]*)\)\s*$', 2) AS version,
    'RubyGems' AS ecosystem FROM mlines WHERE fmt = 3 AND regexp_matches(line, '^    (\S+) \(([0-9][^)]*)\)\s*$')),
pk_composer AS (SELECT repo, file, p->>'name' AS package, ltrim(p->>'version', 'v') AS version, 'Packagist' AS ecosystem
  FROM (SELECT repo, file, unnest(list_concat(json_extract(content, '$.packages[*]'), json_extract(content, '$."packages-dev"[*]'))) AS p
        FROM manifests WHERE fmt = 4) WHERE regexp_matches(ltrim(p->>'version', 'v'), '^[0-9]')),
toml_blocks AS (SELECT repo, file, fmt, unnest(string_split(content, '[[package]]')[2:]) AS block FROM manifests WHERE fmt IN (5, 6)),
pk_toml AS (SELECT repo, file, regexp_extract(block, 'name = "([^"]*)"', 1) AS package, regexp_extract(block, 'version = "([^"]*)"', 1) AS version,
    CASE fmt WHEN 5 THEN 'crates.io' ELSE 'PyPI' END AS ecosystem FROM toml_blocks),
packages AS (SELECT * FROM pk_req UNION ALL SELECT * FROM pk_npm UNION ALL SELECT * FROM pk_go UNION ALL SELECT * FROM pk_gem
  UNION ALL SELECT * FROM pk_composer UNION ALL SELECT * FROM pk_toml)
"""


def vkey(column: str) -> str:
    runs = rf"regexp_extract_all({column}, '\d+')"
    return f"(CASE WHEN len({runs}) > 0 THEN list_transform({runs}, lambda x: x::HUGEINT) ELSE [0::HUGEINT] END)"


_LET = {"AV": (1, "NALP"), "AC": (4, "LH"), "PR": (8, "NLH"), "UI": (24, "NR"), "S": (48, "UC"), "C": (96, "HLN"),
        "I": (288, "HLN"), "A": (864, "HLN")}


def _letter(metric: str) -> str:
    divisor, letters = _LET[metric]
    return f"substr('{letters}', ((p_partkey % 2592) // {divisor} % {len(letters)} + 1)::INT, 1)"


ADVISORIES = f"""
adv_raw AS (SELECT *, {', '.join(f'{_letter(m)} AS m_{m}' for m in _LET)},
   ['PyPI', 'npm', 'Go', 'RubyGems', 'Packagist', 'crates.io'][p_partkey % 6 + 1] AS ecosystem FROM part),
adv_w AS (SELECT *, CASE m_AV WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END AS av,
   CASE m_AC WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END AS ac, CASE m_UI WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END AS ui,
   CASE WHEN m_PR = 'N' THEN 0.85::DOUBLE WHEN m_PR = 'L' THEN CASE m_S WHEN 'C' THEN 0.68::DOUBLE ELSE 0.62 END
        ELSE CASE m_S WHEN 'C' THEN 0.5::DOUBLE ELSE 0.27 END END AS pr,
   CASE m_C WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS wc,
   CASE m_I WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS wi,
   CASE m_A WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22 ELSE 0 END AS wa FROM adv_raw),
adv_iss AS (SELECT *, 1 - (1 - wc) * (1 - wi) * (1 - wa) AS iss FROM adv_w),
adv_imp AS (SELECT *, CASE m_S WHEN 'C' THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15)
   ELSE 6.42::DOUBLE * iss END AS impact, 8.22::DOUBLE * av * ac * pr * ui AS expl FROM adv_iss),
adv_score AS (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 7.5::DOUBLE WHEN p_partkey % 10 = 3 THEN 4.0 WHEN p_partkey % 10 IN (1, 2, 4) THEN NULL
   WHEN impact <= 0 THEN 0.0 ELSE ceil(least(CASE m_S WHEN 'C' THEN 1.08::DOUBLE * (impact + expl) ELSE impact + expl END, 10.0::DOUBLE) * 10) / 10
   END AS score FROM adv_imp),
advisories AS (SELECT p_partkey, 'ADV-' || p_partkey AS vuln_id, ecosystem, 'pkg-' || p_partkey AS package,
   CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW'
        WHEN p_partkey % 10 = 2 THEN 'LOW' ELSE 'MEDIUM' END AS severity,
   CASE WHEN p_partkey % 11 = 0 THEN 'No summary available.' ELSE p_name || ' flaw in ' || p_type END AS summary,
   CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE (p_size % 20) || '.0.0' END AS introduced,
   CASE WHEN p_partkey % 7 <> 0 THEN (p_size % 20 + 5 + p_partkey % 20) || '.1.0' END AS fixed_version,
   p_partkey % 5 = 0 AS second_range FROM adv_score)
"""


def in_range(version: str) -> str:
    def key(column: str) -> str:  # 1.0 and 1.0.0 are one version
        return vkey(f"regexp_replace({column}, '(\\.0+)+$', '')")

    return (f"(({key(version)} >= {key('introduced')} AND (fixed_version IS NULL OR {key(version)} < {key('fixed_version')}))"
            f" OR (second_range AND {key(version)} >= {key(chr(39) + '45.0.0' + chr(39))}))")


def remediation() -> str:
    from sentrymill.fixed_values import packages as P
    cases = " ".join(
        f"WHEN '{e}' THEN " + "replace(replace(" + q(t) + ", '{pkg}', package), '{fix}', fixed_version)"
        for e, _, t in P.ECOSYSTEMS)
    return (f"CASE WHEN fixed_version IS NULL THEN {q(P.NO_FIX_TEXT)} ELSE 'Upgrade to ' || fixed_version || '  ·  ' || "
            f"CASE ecosystem {cases} END END")


VULNERABLE = f"""
vulnerable AS (SELECT p.repo, p.file, p.package, p.version, p.ecosystem, a.severity, a.vuln_id, a.summary AS summary,
   a.fixed_version FROM packages p JOIN advisories a ON p.ecosystem = a.ecosystem AND p.package = a.package AND {in_range('p.version')}),
dep_f AS (SELECT *, {remediation()} AS remediation FROM vulnerable)
"""


def _licences() -> str:
    from workloads import views as v
    ecos = ", ".join(f"'{e}'" for e in v.MANIFEST_ECOSYSTEMS)
    lists = " ".join(f"WHEN {i} THEN " + ("NULL" if c is None else "[" + ", ".join(q(x) for x in c) + "]::VARCHAR[]")
                     for i, c in enumerate(v.LICENCE_CHOICES))
    return f"""licences AS (SELECT DISTINCT [{ecos}][l_orderkey % 7 + 1] AS ecosystem, 'pkg-' || l_partkey AS package,
      l_quantity::INT || '.' || l_linenumber || '.0' AS version, CASE l_partkey % {len(v.LICENCE_CHOICES)} {lists} END AS licenses FROM lineitem)"""


LICENCES = _licences()
BUMPS = f"""
editable AS (SELECT *, replace(lower(package), '_', '-') AS package_key FROM vulnerable
   WHERE fixed_version IS NOT NULL AND regexp_extract(file, '[^/]+$') IN ('requirements.txt', 'package.json')),
bumps AS (SELECT repo, file, package_key, package, version AS old_version, fixed_version AS new_version, ecosystem, vuln_id AS advisory, severity
   FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, package_key
      ORDER BY {vkey('fixed_version')} DESC, vuln_id, version, package, fixed_version) AS rn FROM editable) WHERE rn = 1)
"""


def secret_ctes(source: str, columns: str = "repo, path", prefix: str = "") -> str:
    """Secret findings in SQL: per rule all values of a line, masked in the line and alone."""
    from sentrymill.fixed_values.secrets import SECRET_RULES
    rules = values([(i, *r[:3]) for i, r in enumerate(SECRET_RULES)], "rule, secret_type, category, severity")
    found = ", ".join(f"list_transform(regexp_extract_all(line, {q(r[3])}, {r[4]}), lambda v: {{'rule': {i}, 'value': v}})"
                      for i, r in enumerate(SECRET_RULES))
    cols = columns.split(", ")
    return f"""{prefix}hits AS MATERIALIZED (SELECT *, flatten([{found}]) AS found FROM {lines_of(source, columns)}
       WHERE NOT {suppressed('secret')}),
    {prefix}vals AS (SELECT {columns}, line_no, line, unnest(list_distinct(found)) AS h,
       list_reverse_sort(list_transform(list_distinct(list_transform(found, lambda h: h.value)),
         lambda v: lpad(length(v)::VARCHAR, 6, '0') || v)) AS ordered FROM {prefix}hits WHERE len(found) > 0),
    {prefix}secret_f AS (SELECT DISTINCT {columns}, line_no, r.secret_type, r.category, r.severity, left(h.value, 4) || '****' AS matched_value,
       substr(trim(list_reduce(list_concat([line], list_transform(ordered, lambda v: substr(v, 7))),
          lambda acc, v: replace(acc, v, left(v, 4) || '****')), ' ' || chr(9)), 1, 120) AS masked_context, h.value AS value
       FROM {prefix}vals JOIN (SELECT * FROM {rules}) r ON r.rule = h.rule)"""


VERSIONS = f"""
last_turn AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
file_versions AS (SELECT 'conv' || conv_id AS repo, turn AS commit, 'notes/' || role || '.py' AS path,
   text || chr(10) || CASE WHEN turn < last OR conv_id % 3 = 0 THEN 'key = "{planted.AWS[:16]}' || lpad((conv_id % 10000)::VARCHAR, 4, '0') || '"'
     ELSE 'key = load()' END AS content FROM conversations JOIN last_turn USING (conv_id)),
current_files AS (SELECT repo, path, arg_max(content, commit) AS content FROM file_versions GROUP BY repo, path)
"""


# --- runs, users, schedules, cases, observations ---------------------------------------------

def _case(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def _runs() -> str:
    from workloads import views as v
    return f"""scan_runs AS (SELECT *, critical + high + medium + low AS total FROM (
      SELECT event_id AS id, user_id, {_case('event_type', v.RUN_KINDS)} AS kind, 'repo-' || (user_id % 20) AS target, ts AS created_at,
        k % 3 AS critical, k % 5 AS high, k % 7 AS medium, k % 11 AS low FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))),
    fps AS (SELECT run_id, target, kind, created_at, i AS ord, substr(sha1(target || '|' || num), 1, 12) AS id,
        ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][i % 4 + 1] AS severity, 'rule ' || num || ' @ f.py:' || i AS label
      FROM (SELECT *, ((run_id * 7 + i) % 31)::VARCHAR AS num FROM (SELECT id AS run_id, target, kind, created_at, unnest(range(0, total + 1))::INT AS i FROM scan_runs))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY created_at DESC, id DESC) AS rn FROM scan_runs WHERE kind = 'repo'),
    cur AS (SELECT f.* FROM fps f JOIN ranked r ON r.id = f.run_id AND r.rn = 1),
    prev AS (SELECT f.* FROM fps f JOIN ranked r ON r.id = f.run_id AND r.rn = 2),
    cur1 AS (SELECT target, id, arg_max({{'severity': severity, 'kind': kind, 'label': label}}, ord) AS it FROM cur GROUP BY ALL),
    prev1 AS (SELECT target, id, arg_max({{'severity': severity, 'kind': kind, 'label': label}}, ord) AS it FROM prev GROUP BY ALL),
    diff AS (SELECT coalesce(c.target, p.target) AS target, coalesce(c.id, p.id) AS id, coalesce(c.it, p.it).severity AS severity,
        coalesce(c.it, p.it).kind AS kind, coalesce(c.it, p.it).label AS label,
        CASE WHEN p.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'fixed' ELSE 'unchanged' END AS state
      FROM cur1 c FULL JOIN prev1 p ON c.target = p.target AND c.id = p.id),
    users AS (SELECT c_custkey AS id, CASE WHEN pro THEN 'pro' ELSE 'free' END AS plan,
        CASE WHEN pro AND c_acctbal >= 0 THEN DATE '2023-12-01' + floor(c_acctbal / 100)::INT END AS pro_until
      FROM (SELECT *, c_mktsegment IN ('BUILDING', 'MACHINERY') AS pro FROM customer)),
    schedules AS (SELECT o_orderkey AS id, o_custkey AS owner, ['repo', 'check:dns', 'check:nothing', 'other', 'repo', 'check:tls'][o_orderkey % 6 + 1] AS kind,
        CASE o_orderkey % 6 WHEN 0 THEN 'https://github.com/org/app-' || o_orderkey WHEN 4 THEN 'http://gitlab.com/org/app-' || o_orderkey || '.git'
          WHEN 5 THEN '  ' ELSE 'example.com' END AS target,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'hourly' WHEN '2' THEN 'daily' WHEN '3' THEN 'weekly' WHEN '4' THEN 'monthly' ELSE ' daily ' END AS interval,
        o_orderstatus <> 'F' AS active, CASE WHEN o_orderkey % 10 = 9 THEN 'not a time' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS next_run FROM orders)"""


RUNS = _runs()
CASES = """
cases AS (SELECT 'case-' || source AS id, source AS repo, 'owner-' || (first % 7) AS owner,
   CASE WHEN first % 2 = 0 THEN 'https://github.com/org/' ELSE 'https://gitlab.com/org/' END || source AS repo_url,
   ['pending', 'pending', 'approved', 'dismissed'][first % 4 + 1] AS status, TIMESTAMP '2024-01-01' + (first % 9) * INTERVAL 1 DAY AS created_at
   FROM dot_first)
"""


def _http() -> str:
    from workloads import views as v
    cookies = ", ".join("[" + ", ".join(q(c) for c in cs) + "]::VARCHAR[]" for cs in v.COOKIES)
    return f"""http_obs AS (SELECT page_id, url, host, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^https://', 'http://')
        ELSE regexp_replace(url, '^http://', 'https://') END AS final_url,
      CASE WHEN page_id % 9 = 0 THEN 301 WHEN page_id % 9 = 1 THEN 404 ELSE 200 END AS status,
      CASE WHEN page_id % 2 = 0 THEN [{', '.join(q(h) for h in v.HSTS)}][page_id % 3 + 1] END AS hsts, page_id % 3 = 0 AS csp, page_id % 4 <> 0 AS xcto,
      page_id % 5 <> 1 AS xfo, page_id % 6 = 0 AS referrer, page_id % 7 = 0 AS permissions,
      CASE page_id % 3 WHEN 0 THEN 'nginx/1.18.0' WHEN 1 THEN 'cloudflare' END AS server, CASE WHEN page_id % 8 = 0 THEN 'PHP/8.1' END AS powered,
      CASE WHEN page_id % 6 <= 1 THEN '{v.PROBE_ORIGIN}' WHEN page_id % 6 = 2 THEN '*' END AS acao, page_id % 6 = 0 AS acac,
      [{cookies}][page_id % 5 + 1] AS cookies,
      CASE page_id % 3 WHEN 0 THEN 'https://' || host || '/' WHEN 1 THEN 'http://other.example/' END AS location,
      html || CASE WHEN page_id % 4 = 0 THEN '<img src="http://cdn' || (page_id % 7) || '.example.com/a.png"><a href=''http://x.example.org/' || page_id || '''>' ELSE '' END AS body
      FROM (SELECT *, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)),
    hosts AS (SELECT host, (ascii(h[1]) * 16 + ascii(h[2])) % 97 - 30 AS n, ascii(h[2]) % 6 AS m, ascii(h[3]) % 4 AS x
      FROM (SELECT DISTINCT host, sha1(host) AS h FROM http_obs)),
    tls_obs AS (SELECT host, x = 0 AS tls10, x <= 1 AS tls11, trunc((n * 24 + x * 6) / 24.0)::INT AS days, CASE WHEN m > 0 THEN 'CA ' || m END AS issuer FROM hosts)"""


HTTP = _http()


def union_rules(source: str, check_id: str, target: str, rules) -> str:
    """UNION ALL of (condition, severity, title, detail) given as SQL."""
    return " UNION ALL ".join(
        f"SELECT '{check_id}' AS check_id, {target} AS target, {sev} AS severity, {title} AS title, {detail} AS detail FROM {source} WHERE {cond}"
        for cond, sev, title, detail in rules)


EXPIRY = [("days < 0", "'CRITICAL'", "'TLS certificate expired'", "'Expired ' || abs(days) || ' day(s) ago.'"),
          ("days >= 0 AND days < 15", "'HIGH'", "'TLS certificate expiring soon'", "days || ' day(s) left.'"),
          ("days >= 15 AND days < 30", "'MEDIUM'", "'TLS certificate expiring soon'", "days || ' day(s) left.'")]
