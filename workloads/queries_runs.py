"""Registered queries over runs, users, schedules, cases and unified findings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.fixed_values.guidance import GENERIC_GUIDANCE, GUIDANCE
from sentrymill.operators import cases, diff, explain, exports, manifests, rollups, schedules
from sentrymill.plans import scan
from sentrymill.session import checkpoint_folder, durable, spread_join
from sentrymill.sources import stores
from workloads import duck, views
from workloads.queries import _IGNORED, _LIC, _PA, _bumps, _declared, _advisories, query

_R = duck.with_(duck.RUNS)


def _ts(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_RUN = "id, user_id, kind, target, critical, high, medium, low, total"


def _two_latest(spark, d) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the newest and the second newest repo run per target."""
    runs = views.scan_runs(spark, d).where(F.col("kind") == "repo")
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("created_at"), F.desc("id")))
    top = runs.select(F.col("id").alias("run_id"), rank.alias("rn"))
    fps = spread_join(views.run_fingerprints(spark, d), top.where(F.col("rn") <= 2), ["run_id"])
    return fps.where(F.col("rn") == 1), fps.where(F.col("rn") == 2)


def _diff(spark, d) -> DataFrame:
    current, previous = _two_latest(spark, d)
    return diff.run_diff(previous, current)


@query(f"{_R} SELECT * FROM diff")
def run_diff(spark, d):
    return _diff(spark, d)


@query(f"""{_R} SELECT target, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'fixed') AS fixed,
   count(*) FILTER (state = 'unchanged') AS unchanged FROM diff GROUP BY target""")
def run_diff_counts(spark, d):
    return diff.change_counts(_diff(spark, d))


@query(f"""{_R} SELECT {_RUN}, {_TS.format('created_at')} FROM scan_runs
   QUALIFY row_number() OVER (PARTITION BY target, kind ORDER BY created_at DESC, id DESC) = 1""")
def latest_run(spark, d):
    return diff.latest_runs(views.scan_runs(spark, d), kind=None).withColumn("created_at", _ts("created_at"))


@query(f"""{_R} SELECT count(*) AS total, count(*) FILTER (created_at::DATE = DATE '{views.TODAY}') AS today, sum(total)::BIGINT AS findings FROM scan_runs""")
def run_stats(spark, d):
    return rollups.run_stats(views.scan_runs(spark, d), F.lit(views.TODAY).cast("date"))


@query(f"{_R} SELECT kind, count(*) AS runs FROM scan_runs GROUP BY kind ORDER BY runs DESC, kind LIMIT 6")
def top_kinds(spark, d):
    return rollups.top_kinds(views.scan_runs(spark, d))


@query(f"""{_R}, used AS (SELECT user_id, count(*) AS n FROM scan_runs WHERE date_trunc('month', created_at) = DATE '2024-01-01' GROUP BY 1),
   eff AS (SELECT id, CASE WHEN plan = 'pro' AND pro_until < DATE '{views.TODAY}' THEN 'free' ELSE plan END AS plan FROM users)
   SELECT id, plan, coalesce(n, 0) AS used, CASE WHEN plan <> 'pro' THEN greatest(0, 20 - coalesce(n, 0)) END AS remaining
   FROM eff LEFT JOIN used ON user_id = id""")
def monthly_quota(spark, d):
    return rollups.monthly_quota(views.users(spark, d), views.scan_runs(spark, d), F.lit(views.TODAY).cast("date"))


@query(f"""{_R} SELECT id, plan, plan = 'pro' AS is_pro, coalesce(n, 0) AS runs FROM users LEFT JOIN (SELECT user_id, count(*) AS n FROM scan_runs GROUP BY 1) ON user_id = id""")
def user_overview(spark, d):
    return rollups.user_overview(views.users(spark, d), views.scan_runs(spark, d))


@query(f"{_R} SELECT count(*) AS users, count(*) FILTER (plan = 'pro') AS pro FROM users")
def user_totals(spark, d):
    return rollups.user_totals(views.users(spark, d))


@query(f"{_R} SELECT {_RUN}, {_TS.format('created_at')} FROM scan_runs WHERE user_id = 7")
def owner_history(spark, d):
    return rollups.visible_runs(views.scan_runs(spark, d), 7).withColumn("created_at", _ts("created_at"))


@query(f"{_R} SELECT {_RUN}, {_TS.format('created_at')} FROM (SELECT * FROM scan_runs ORDER BY created_at DESC, id DESC LIMIT 10)")
def recent_runs(spark, d):
    return rollups.recent_runs(views.scan_runs(spark, d), 10).withColumn("created_at", _ts("created_at"))


@query(f"""{_R} SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S') AS start, kind, count(*) AS runs, sum(total)::BIGINT AS findings FROM scan_runs GROUP BY ALL""")
def windowed_run_counts(spark, d):
    return rollups.windowed_counts(views.scan_runs(spark, d)).withColumn("start", _ts("start"))


@query(f"""{_R} SELECT id, target, severity, label, run_id FROM fps QUALIFY row_number() OVER (PARTITION BY target, id ORDER BY created_at, run_id, ord) = 1""")
def stream_dedupe(spark, d):
    """Batch form of the stream that keeps the first occurrence of every fingerprint."""
    fps = views.run_fingerprints(spark, d)
    first = fps.groupBy("target", "id").agg(F.min(F.struct("created_at", "run_id", "ord", "severity", "label")).alias("f"))
    return first.select("id", "target", "f.severity", "f.label", "f.run_id")


@query(f"{_R} SELECT * FROM schedules WHERE active AND try_cast(next_run AS TIMESTAMP) <= TIMESTAMP '{views.SCHEDULE_NOW}'")
def due_schedules(spark, d):
    return schedules.due(views.schedules(spark, d), views.at(views.SCHEDULE_NOW))


@query(f"""{_R} SELECT id, interval, strftime(TIMESTAMP '{views.SCHEDULE_NOW}' + CASE interval WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END,
   '%Y-%m-%d %H:%M:%S') AS next_run, '{views.SCHEDULE_NOW}' AS last_run FROM schedules WHERE active AND try_cast(next_run AS TIMESTAMP) <= TIMESTAMP '{views.SCHEDULE_NOW}'""")
def advanced_schedules(spark, d):
    now = views.at(views.SCHEDULE_NOW)
    moved = schedules.advanced(schedules.due(views.schedules(spark, d), now), now)
    return moved.select("id", "interval", _ts("next_run"), _ts("last_run"))


@query(f"""{_R} SELECT s.id, CASE WHEN NOT coalesce(u.plan = 'pro' AND (pro_until IS NULL OR pro_until >= DATE '{views.TODAY}'), false) THEN 'plan'
     WHEN trim(interval) NOT IN ('hourly', 'daily', 'weekly') THEN 'interval'
     WHEN kind = 'repo' AND NOT regexp_matches(target, '^https://github\\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$') THEN 'repository'
     WHEN kind = 'check:nothing' THEN 'check' WHEN kind = 'other' THEN 'kind' WHEN trim(target) = '' THEN 'target' END AS reason
   FROM schedules s JOIN users u ON u.id = s.owner""")
def schedule_validation(spark, d):
    users = views.users(spark, d).select(F.col("id").alias("owner"), "plan", "pro_until")
    requests = spread_join(views.schedules(spark, d), users, ["owner"])
    plan = rollups.effective_plan(F.lit(views.TODAY).cast("date"))
    return schedules.validated(requests, plan).select("id", "reason")


@query(r"""WITH u AS (SELECT [ 'https://github.com/org/app-' || o_orderkey, 'http://github.com/org/app-' || o_orderkey || '.git', 'https://github.com/org/app-' || o_orderkey || '/',
     'https://gitlab.com/org/app-' || o_orderkey, 'https://example.com/org/app-' || o_orderkey, 'https://github.com/app-' || o_orderkey][o_orderkey % 6 + 1] AS url, o_orderkey AS k FROM orders)
   SELECT url, CASE WHEN k % 6 < 3 THEN 'org' END AS owner, CASE WHEN k % 6 < 3 THEN 'app-' || k END AS name, k % 6 <> 4 AS cloneable, k % 6 IN (0, 2) AS schedulable FROM u""")
def repo_urls(spark, d):
    return schedules.parsed_repos(views.repo_urls(spark, d))


# --- unified findings ------------------------------------------------------------------------

def _scan_files(spark, d) -> DataFrame:
    return views.files(spark, d)


def _code_and_secrets(spark, d) -> DataFrame:
    """Code and secret findings of the document files, without ignore rules."""
    return scan.scan(_scan_files(spark, d), ("secrets", "code"), use_default_ignores=False, ignore_file=None)


def _everything(spark, d) -> DataFrame:
    """All five phases: documents as files, line items as manifests, conversations as history."""
    manifest_files = views.manifests(spark, d)
    versions = views.file_versions(spark, d)
    both = _code_and_secrets(spark, d)
    declared = scan.scan(manifest_files, ("deps", "licenses"), _advisories(spark, d), views.licence_feed(spark, d),
                         use_default_ignores=False, ignore_file=None)
    past = scan.scan(views.current_files(versions), ("git_history",), versions=versions)
    return both.unionByName(declared).unionByName(past)


def _null(names: str) -> str:
    return ", ".join(f"NULL AS {n}" for n in names.split())


_CODE_UNION = f"""
hyg AS (SELECT repo, '.gitignore' AS path, 0 AS line_no, 'Sensitive file type not git-ignored: ' || kind AS issue_type, 'hygiene' AS category, 'MEDIUM' AS severity,
   'Files matching ''' || kind || ''' are present but not covered by .gitignore — they risk being committed. Add an ignore rule.' AS description, '' AS context
   FROM (SELECT DISTINCT repo, CASE WHEN regexp_matches(path, '(^|/)\\.env$') THEN '.env' WHEN ends_with(path, '.pem') THEN '*.pem' WHEN ends_with(path, '/id_rsa') THEN 'id_rsa' END AS kind FROM files) s
   WHERE kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT repo, trim(line) AS e FROM (SELECT repo, unnest(string_split(lower(content), chr(10))) AS line FROM files WHERE path = '.gitignore')
      WHERE NOT starts_with(line, '#') AND trim(line) <> '') gi WHERE gi.repo = s.repo AND (contains(e, ltrim(kind, '*')) OR contains(kind, ltrim(e, '*'))))),
code_u AS (SELECT * FROM code_f UNION ALL SELECT * FROM docker_f UNION ALL SELECT * FROM iac_f UNION ALL SELECT * FROM ci_f UNION ALL SELECT * FROM hyg),
cs AS (SELECT repo AS target, 'code' AS phase, 'Code' AS kind, path AS file, line_no, issue_type, category, severity, description, NULL AS matched_value, context FROM code_u
  UNION ALL SELECT repo, 'secrets', 'Secret', path, line_no, secret_type, category, severity, NULL, matched_value, masked_context FROM secret_f)
"""
_CS = duck.with_(duck.FILES, duck.FILE_KINDS, duck.CODE_ALL, duck.secret_ctes("files"), _CODE_UNION)
_ALL = duck.with_(duck.FILES, duck.FILE_KINDS, duck.CODE_ALL, duck.secret_ctes("files"), _CODE_UNION, _LIC[5:], duck.ADVISORIES, duck.VULNERABLE,
                  duck.VERSIONS, duck.secret_ctes("file_versions", "repo, path, commit", "past_"),
                  duck.secret_ctes("current_files", "repo, path", "now_"), """
hist_f AS (SELECT p.* FROM past_secret_f p WHERE NOT EXISTS (SELECT 1 FROM now_secret_f n WHERE n.repo = p.repo AND n.path = p.path AND n.secret_type = p.secret_type AND n.value = p.value)),
everything AS (
 SELECT target, phase, kind, file, line_no, issue_type, category, severity, description, NULL AS package, NULL AS version, NULL AS vuln_id, NULL AS license, matched_value, context FROM cs
 UNION ALL SELECT repo, 'deps', 'Dependency', file, NULL, NULL, 'dep', severity, summary, package, version, vuln_id, NULL, NULL, NULL FROM dep_f
 UNION ALL SELECT repo, 'licenses', 'License', file, NULL, NULL, 'license', severity, reason, package, version, NULL, license, NULL, NULL FROM license_f
 UNION ALL SELECT repo, 'git_history', 'Secret', path, line_no, secret_type, category, severity, NULL, NULL, NULL, NULL, NULL, matched_value, masked_context FROM hist_f)""")
_EVERY = "target phase kind file line_no issue_type category severity description package version vuln_id license matched_value context"


@query(f"{_ALL} SELECT {', '.join(_EVERY.split())} FROM everything")
def all_findings(spark, d):
    return _everything(spark, d).select(*_EVERY.split())


@query(f"""{_ALL} SELECT target, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
   count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (phase <> 'licenses') AS total FROM everything GROUP BY target""")
def target_counts(spark, d):
    return rollups.severity_counts(_everything(spark, d))


@query(f"""{_CS}, hidden AS (SELECT repo, path FROM ({_IGNORED}) WHERE ignored)
   SELECT target, phase, file, line_no, issue_type, severity FROM cs
   WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE hidden.repo = cs.target AND hidden.path = cs.file)""")
def visible_findings(spark, d):
    """Code and secret findings with the built-in ignore patterns and the ignore files of the repositories."""
    return scan.scan(_scan_files(spark, d), ("secrets", "code")).select("target", "phase", "file", "line_no", "issue_type", "severity")


_FP = """fp AS (SELECT target, severity, CASE phase WHEN 'secrets' THEN 'secret' WHEN 'deps' THEN 'dependency' WHEN 'licenses' THEN 'license' ELSE phase END AS kind,
  substr(sha1(CASE phase WHEN 'secrets' THEN concat('secret|', issue_type, '|', file, '|', line_no) WHEN 'code' THEN concat('code|', issue_type, '|', file, '|', line_no)
    WHEN 'deps' THEN concat('dep|', package, '|', version, '|', vuln_id) WHEN 'git_history' THEN concat('git|', issue_type, '|', file)
    ELSE concat('license|', package, '|', version, '|', license) END), 1, 12) AS id,
  CASE phase WHEN 'secrets' THEN concat(issue_type, ' @ ', file, ':', line_no) WHEN 'code' THEN concat(issue_type, ' @ ', file, ':', line_no)
    WHEN 'deps' THEN concat(package, '@', version, ' (', vuln_id, ')') WHEN 'git_history' THEN concat(issue_type, ' (', file, ')')
    ELSE concat(package, '@', version, ': ', license) END AS label FROM everything)"""


@query(f"{_ALL}, {_FP} SELECT target, id, severity, kind, label FROM fp")
def finding_fingerprints(spark, d):
    return diff.fingerprints(_everything(spark, d))


@query(f"{_CS} SELECT target, phase, file, line_no, issue_type, severity FROM cs WHERE severity IN ('CRITICAL', 'LOW')")
def severity_filter(spark, d):
    return rollups.only_severities(_code_and_secrets(spark, d), ["critical", "Low"]).select(
        "target", "phase", "file", "line_no", "issue_type", "severity")


@query(f"""{_CS}, n AS (SELECT target, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h FROM cs GROUP BY target)
   SELECT target, c + h > 0 AS failed, concat_ws(', ', CASE WHEN c > 0 THEN c || ' CRITICAL' END, CASE WHEN h > 0 THEN h || ' HIGH' END) AS summary FROM n""")
def severity_gate(spark, d):
    return rollups.gate(_code_and_secrets(spark, d), "high")


@query(f"""{_CS} SELECT target, severity, CASE phase WHEN 'secrets' THEN 'Secret: ' ELSE 'Insecure code: ' END || issue_type AS title,
   file || ':' || line_no || CASE phase WHEN 'secrets' THEN ' (' || matched_value || ')' ELSE '' END AS detail, 'repo' AS check_id FROM cs""")
def repo_check_rows(spark, d):
    from sentrymill.operators import checks
    return checks.repo_rows(_code_and_secrets(spark, d))


_D = duck.with_(duck.FILES, duck.FILE_KINDS, duck.CODE_ALL, duck.secret_ctes("files"), _CODE_UNION, duck.CASES, """
disc AS (SELECT target, kind, issue_type AS type, severity, category, file, line_no AS line, coalesce(matched_value, description) AS detail,
   repo_url || CASE WHEN contains(repo_url, 'gitlab.com') THEN '/-/blob/HEAD/' ELSE '/blob/HEAD/' END || file || '#L' || line_no AS url,
   substr(sha256(target || '|' || issue_type || '|' || file || '|' || line_no), 1, 16) AS key FROM cs JOIN cases ON cases.repo = cs.target),
case_f AS (SELECT target AS repo, kind, type, CASE WHEN line % 7 <> 0 THEN severity END AS severity, CASE WHEN line % 5 <> 0 THEN category END AS category, file, line FROM disc)""")


def _disclosed(spark, d) -> DataFrame:
    found = _code_and_secrets(spark, d).withColumn("repo", F.col("target"))
    urls = views.cases(spark, d).select("repo", "repo_url")
    return cases.disclosure_findings(spread_join(found, urls, ["repo"]), F.col("repo_url"))


def _case_findings(spark, d) -> DataFrame:
    """Findings of stored cases; some lack a severity or a category, as older records do."""
    return _disclosed(spark, d).select(
        F.col("target").alias("repo"), "kind", "type", F.when(F.col("line") % 7 != 0, F.col("severity")).alias("severity"),
        F.when(F.col("line") % 5 != 0, F.col("category")).alias("category"), "file", "line")


@query(f"{_D} SELECT target, kind, type, severity, category, file, line, detail, url, key FROM disc")
def disclosure_findings(spark, d):
    return _disclosed(spark, d).drop("context")


_ANN = """ann AS (SELECT c.repo, c.status, c.created_at, count(f.repo) FILTER (upper(coalesce(severity, 'LOW')) = 'CRITICAL') AS critical, count(f.repo) FILTER (upper(coalesce(severity, 'LOW')) = 'HIGH') AS high,
   count(f.repo) FILTER (upper(coalesce(severity, 'LOW')) = 'MEDIUM') AS medium, count(f.repo) FILTER (upper(coalesce(severity, 'LOW')) = 'LOW') AS low, count(f.repo) AS finding_count
   FROM cases c LEFT JOIN case_f f ON f.repo = c.repo GROUP BY ALL),
ranked AS (SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' ELSE 'LOW' END AS worst FROM ann)"""


@query(f"{_D}, {_ANN} SELECT repo, status, critical, high, medium, low, finding_count, worst FROM ranked")
def case_ranking(spark, d):
    return cases.annotated(views.cases(spark, d).select("repo", "status", "created_at"), _case_findings(spark, d)).drop("created_at")


@query(f"""{_D}, {_ANN} SELECT count(*) FILTER (worst = 'CRITICAL') AS critical, count(*) FILTER (worst = 'HIGH') AS high, count(*) FILTER (worst = 'MEDIUM') AS medium,
   count(*) FILTER (worst = 'LOW') AS low FROM ranked WHERE status = 'pending'""")
def case_buckets(spark, d):
    pending = cases.by_status(views.cases(spark, d), "pending").select("repo", "created_at")
    return cases.worst_buckets(cases.annotated(pending, _case_findings(spark, d)))


@query(f"""{_D} SELECT {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in cases.STATUSES)} FROM cases""")
def case_status_counts(spark, d):
    return cases.status_counts(views.cases(spark, d))


@query(f"{_D} SELECT id, repo, owner, repo_url, status, {_TS.format('created_at')} FROM cases WHERE status = 'approved'")
def cases_by_status(spark, d):
    return cases.by_status(views.cases(spark, d), "approved").withColumn("created_at", _ts("created_at"))


_GUIDE = duck.values(GUIDANCE, "cat, impact, fix")


@query(f"""{_D}, firsts AS (SELECT repo, lower(coalesce(category, '')) AS k, min({{'kind': kind, 'file': file, 'line': line, 'type': type}}) AS f,
     arg_min(CASE WHEN coalesce(category, '') = '' THEN lower(coalesce(kind, 'general')) ELSE lower(category) END, {{'kind': kind, 'file': file, 'line': line, 'type': type}}) AS shown FROM case_f GROUP BY ALL)
   SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY f)::INT AS position, shown AS category, coalesce(impact, {duck.q(GENERIC_GUIDANCE[0])}) AS impact,
     coalesce(fix, {duck.q(GENERIC_GUIDANCE[1])}) AS fix FROM firsts LEFT JOIN {_GUIDE} ON cat = k""")
def case_guidance(spark, d):
    return cases.guidance(_case_findings(spark, d), ["kind", "file", "line", "type"])


@query(f"""{_D}, looked AS (SELECT repo, row_number() OVER (ORDER BY repo) AS arrival FROM (SELECT repo FROM cases WHERE status <> 'dismissed')),
   n AS (SELECT l.repo, l.arrival, count(f.repo) AS found FROM looked l LEFT JOIN case_f f ON f.repo = l.repo AND f.severity IN ('CRITICAL', 'HIGH') GROUP BY ALL),
   s AS (SELECT *, coalesce(sum(found) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS found_before FROM n)
   SELECT repo, found, found_before, found > 0 AS queued FROM s WHERE found_before < 50""")
def disclosure_until_n(spark, d):
    tracked = views.cases(spark, d).where(F.col("status") == "dismissed").select("repo")
    fresh = views.cases(spark, d).select("repo").join(tracked, "repo", "left_anti").withColumn("arrival", F.col("repo"))
    return cases.until_n(fresh, _case_findings(spark, d), ["critical", "high"], target=50).drop("arrival")


@query(f"""{_D} SELECT DISTINCT target AS repo, 'finder' AS owner, 'https://github.com/' || target AS repo_url, 'pending' AS status FROM disc
   WHERE target NOT IN (SELECT repo FROM cases WHERE status = 'approved')""")
def new_cases(spark, d):
    candidates = _disclosed(spark, d).select(F.col("target").alias("repo"), F.lit("finder").alias("owner"),
                                             F.lit(None).cast("string").alias("repo_url"))
    return cases.new_cases(candidates, cases.by_status(views.cases(spark, d), "approved"))


# --- prompts and exports ---------------------------------------------------------------------

_PROMPT = """prompted AS (SELECT *, 'Issue: ' || issue_type || chr(10) || 'Category: ' || category || chr(10) || 'Severity: ' || upper(severity) || chr(10) || 'File: ' || file || ':' || line_no || chr(10)
   || 'Code: ' || context || chr(10) || 'Description: ' || description AS prompt FROM (SELECT repo AS target, path AS file, * FROM code_f))"""


def _prompted(spark, d) -> DataFrame:
    from workloads.queries import code_findings
    found = code_findings(spark, d).select(F.col("repo").alias("target"), F.col("path").alias("file"), F.lit("code").alias("phase"),
                                           "line_no", "issue_type", "category", "severity", "description", "context")
    return explain.prompts(found, "explainer")


_C = duck.with_(duck.FILES, duck.FILE_KINDS, duck.CODE_ALL, _PROMPT)


@query(f"{_C} SELECT target, file, line_no, prompt, sha1('explainer' || chr(10) || prompt) AS key FROM prompted")
def explain_prompts(spark, d):
    return _prompted(spark, d).select("target", "file", "line_no", "prompt", "key")


@query(f"""{_C}, keyed AS (SELECT DISTINCT sha1('explainer' || chr(10) || prompt) AS key, prompt, severity FROM prompted)
   SELECT DISTINCT key, prompt FROM keyed WHERE severity <> 'HIGH'""")
def uncached_prompts(spark, d):
    """The cache holds texts for the HIGH findings, and empty texts for the CRITICAL ones."""
    prompted = _prompted(spark, d)
    cache = prompted.where(F.col("severity").isin("HIGH", "CRITICAL")).select(
        "key", F.when(F.col("severity") == "HIGH", "text").otherwise("").alias("text")).distinct()
    return explain.uncached(prompted, cache)


_T = "2024-01-15T12:00:00Z"
_UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)"
_COMP = f"""comp AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ecosystem, lower(name), version, name) - 1 AS position,
   'pkg:' || CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang' WHEN 'RubyGems' THEN 'gem' WHEN 'Packagist' THEN 'composer' WHEN 'crates.io' THEN 'cargo' ELSE lower(ecosystem) END || '/' || name || '@' || version AS purl
   FROM (SELECT repo, ecosystem, package AS name, version, min(file) AS file FROM packages GROUP BY ALL)),
 docs AS (SELECT DISTINCT repo, sha1('sentrymill|' || repo) AS h FROM comp)"""


@query(f"""{_PA}, {_COMP} SELECT repo, 0 AS part, 0::BIGINT AS position, '{{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:' || {_UUID} || '","version":1,"metadata":{{"timestamp":"{_T}","tools":[{{"vendor":"sentrymill","name":"sentrymill"}}],"component":{{"type":"application","name":"' || repo || '","bom-ref":"' || repo || '"}}}},"components":[' AS text FROM docs
  UNION ALL SELECT repo, 1, position, CASE WHEN position > 0 THEN ',' ELSE '' END || '{{"type":"library","name":"' || name || '","version":"' || version || '","purl":"' || purl || '","bom-ref":"' || purl || '","properties":[{{"name":"sentrymill:manifest","value":"' || file || '"}}]}}' FROM comp
  UNION ALL SELECT repo, 2, 0, ']}}' FROM docs""")
def sbom_cyclonedx(spark, d):
    return exports.sbom(manifests.ordered_components(_declared(spark, d)), "cyclonedx", _T)


@query(f"""{_PA}, {_COMP} SELECT repo, 0 AS part, 0::BIGINT AS position, '{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"' || repo || '","documentNamespace":"https://sentrymill/spdx/' || repo || '-' || {_UUID} || '","creationInfo":{{"created":"{_T}","creators":["Tool: sentrymill"]}},"packages":[{{"name":"' || repo || '","SPDXID":"SPDXRef-RootPackage","downloadLocation":"NOASSERTION","filesAnalyzed":false}}' AS text FROM docs
  UNION ALL SELECT repo, 1, position, ',{{"name":"' || name || '","SPDXID":"SPDXRef-Package-' || position || '","versionInfo":"' || version || '","downloadLocation":"NOASSERTION","licenseConcluded":"NOASSERTION","licenseDeclared":"NOASSERTION","filesAnalyzed":false,"externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"' || purl || '"}}]}}' FROM comp
  UNION ALL SELECT repo, 2, 0, '],"relationships":[' FROM docs
  UNION ALL SELECT repo, 3, position, CASE WHEN position > 0 THEN ',' ELSE '' END || '{{"spdxElementId":"SPDXRef-RootPackage","relatedSpdxElement":"SPDXRef-Package-' || position || '","relationshipType":"DEPENDS_ON"}}' FROM comp
  UNION ALL SELECT repo, 4, 0, ']}}' FROM docs""")
def sbom_spdx(spark, d):
    return exports.sbom(manifests.ordered_components(_declared(spark, d)), "spdx", _T)


@query(f"""{_PA} SELECT repo AS target, 'deps' AS phase, to_json({{'file': file, 'package': package, 'version': version, 'ecosystem': ecosystem, 'severity': severity, 'vuln_id': vuln_id, 'description': summary, 'fixed_version': fixed_version}})::VARCHAR AS json FROM dep_f""")
def findings_json(spark, d):
    found = scan.scan(views.manifests(spark, d), ("deps",), _advisories(spark, d), use_default_ignores=False, ignore_file=None)
    return exports.findings_json(found)


@query(f"""{_CS} SELECT target, to_json({{'target': target, 'severity_counts': {{'CRITICAL': count(*) FILTER (severity = 'CRITICAL'), 'HIGH': count(*) FILTER (severity = 'HIGH'),
   'MEDIUM': count(*) FILTER (severity = 'MEDIUM'), 'LOW': count(*) FILTER (severity = 'LOW')}}, 'errors': []::VARCHAR[]}})::VARCHAR AS json FROM cs GROUP BY target""")
def scan_summary_json(spark, d):
    return exports.scan_summary_json(_code_and_secrets(spark, d))


@query(f"""{_ALL} SELECT target, phase, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END AS sev_rank, severity,
   CASE WHEN phase IN ('deps', 'licenses') THEN package || '@' || version ELSE issue_type END AS subject,
   CASE phase WHEN 'deps' THEN vuln_id WHEN 'licenses' THEN file ELSE file || ':' || line_no END AS place,
   CASE WHEN phase IN ('secrets', 'git_history') THEN matched_value ELSE description END AS note FROM everything""")
def report_sections(spark, d):
    return exports.report_rows(_everything(spark, d))


@query(f"""{_CS}, n AS (SELECT target, sev AS severity, count(*) FILTER (severity = sev) AS findings, count(*) AS total FROM cs, (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(sev) GROUP BY target, sev)
   SELECT target, severity, findings, round(findings * 100.0::DOUBLE / total, 1) AS share FROM n""")
def severity_shares(spark, d):
    return exports.severity_shares(_code_and_secrets(spark, d))


@query(f"""{_D}, flag AS (SELECT repo, bool_or(kind = 'Secret') AS s FROM case_f GROUP BY repo)
  SELECT repo, 0 AS part, '' AS kind, '' AS file, 0 AS line, '' AS type, 'Hello @' || owner || ',' || chr(10) || chr(10) || 'An automated security scan flagged potential issues in your public repository ' || repo || ':' || chr(10) AS text FROM cases
  UNION ALL SELECT f.repo, 1, CASE kind WHEN 'Secret' THEN 'a' ELSE 'b' END, file, line, type, '  - [' || coalesce(severity, '?') || '] ' || kind || ': ' || type || ' in ' || file || ':' || line FROM case_f f JOIN cases USING (repo)
  UNION ALL SELECT repo, 2, '', '', 0, '', CASE WHEN coalesce(s, false) THEN {duck.q(chr(10) + "The items marked 'Secret' look like hardcoded credentials — please rotate them and remove them from the repository history (e.g. with `git filter-repo`)." + chr(10))} ELSE '' END
     || {duck.q(chr(10) + "For your safety, any secret values were never stored or used — only their type and location." + chr(10) + chr(10) + "— Automated responsible-disclosure notice from sentrymill")} FROM cases LEFT JOIN flag USING (repo)""")
def notice_text(spark, d):
    return exports.notice(views.cases(spark, d), _case_findings(spark, d))


@query(f"""{_PA} SELECT DISTINCT repo, 0 AS part, '' AS package, '' AS file, {duck.q('''## sentrymill — dependency security fixes

This PR bumps dependencies with known vulnerabilities to a fixed version.

| Package | From | To | Advisory | Severity |
|---|---|---|---|---|''')} AS text FROM bumps
  UNION ALL SELECT repo, 1, lower(package), file, '| `' || package || '` | ' || old_version || ' | ' || new_version || ' | ' || advisory || ' | ' || severity || ' |' FROM bumps
  UNION ALL SELECT DISTINCT repo, 2, '', '', {duck.q(chr(10) + "_Generated by sentrymill. Review the changes and run your tests before merging._")} FROM bumps""")
def fix_body(spark, d):
    return exports.fix_body(_bumps(spark, d))


_EM = "CASE severity WHEN 'CRITICAL' THEN ':red_circle:' WHEN 'HIGH' THEN ':large_orange_circle:' WHEN 'MEDIUM' THEN ':large_yellow_circle:' WHEN 'LOW' THEN ':large_blue_circle:' ELSE '' END"


@query(f"""{_R}, c AS (SELECT target, count(*) FILTER (state = 'new') AS n, count(*) FILTER (state = 'fixed') AS f, count(*) FILTER (state = 'unchanged') AS u FROM diff GROUP BY target),
   l AS (SELECT target, 0 AS part, row_number() OVER (PARTITION BY target ORDER BY severity, id) AS rn, '  • _new_ ' || {_EM} || ' *' || severity || '* — ' || label AS line FROM diff WHERE state = 'new'
     UNION ALL SELECT target, 1, row_number() OVER (PARTITION BY target ORDER BY id) AS rn, '  • _fixed_ :white_check_mark: ' || label FROM diff WHERE state = 'fixed' QUALIFY rn <= 10)
   SELECT target, 'sentrymill: ' || n || ' new / ' || f || ' fixed on ' || target AS text, substr('*Target:* `' || target || '`' || chr(10) || ':warning: *' || n || ' new*   :white_check_mark: *' || f || ' fixed*   (' || u || ' unchanged)' || chr(10)
     || (SELECT string_agg(line, chr(10) ORDER BY part, rn) FROM l WHERE l.target = c.target), 1, 2900) AS detail FROM c WHERE n + f > 0""")
def notify_payload(spark, d):
    return exports.change_payload(_diff(spark, d), text_chars=2900, fixed_shown=10)


@query(f"""{_R}, c AS (SELECT target, count(*) FILTER (state = 'new') AS n, count(*) FILTER (state = 'fixed') AS f, count(*) FILTER (state = 'unchanged') AS u FROM diff GROUP BY target)
   SELECT target, 0 AS part, '' AS "order", '' AS id, '*Target:* `' || target || '`' || chr(10) || ':warning: *' || n || ' new*   :white_check_mark: *' || f || ' fixed*   (' || u || ' unchanged)' AS text FROM c WHERE n + f > 0
   UNION ALL SELECT target, 1, severity, id, '  • _new_ ' || {_EM} || ' *' || severity || '* — ' || label FROM diff WHERE state = 'new'
   UNION ALL SELECT target, 2, '', id, '  • _fixed_ :white_check_mark: ' || label FROM diff WHERE state = 'fixed'""")
def change_messages(spark, d):
    return exports.change_pieces(_diff(spark, d))


def _new_store(spark) -> str:
    return f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"


@query(f"{_R} SELECT {_RUN} FROM scan_runs")
def stored_runs(spark, d):
    """All runs through the store, repository runs first, the others appended."""
    runs, path = views.scan_runs(spark, d), _new_store(spark)
    is_repo = F.coalesce(F.col("kind") == "repo", F.lit(False))
    stores.append_runs(runs.where(is_repo), path)
    stores.append_runs(runs.where(~is_repo), path)
    return stores.read(spark, path, stores.RUNS).select(*_RUN.split(", "))


@query(f"{_D} SELECT repo, owner, repo_url, status FROM cases")
def stored_cases(spark, d):
    """All cases through the store: added twice, and then under the status of their newest valid event."""
    given, path, events = views.cases(spark, d), _new_store(spark), _new_store(spark)
    candidates = given.select("repo", "owner", "repo_url")
    stores.add_cases(candidates, path)
    stores.add_cases(candidates, path)  # tracked by now
    event = given.select(F.sha1("repo").alias("id"), "status", F.col("created_at").alias("ts"))
    stores.set_status(event.withColumn("status", F.lit("dismissed")).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY")), events)
    stores.set_status(event.unionByName(event.withColumn("status", F.lit("unheard of")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))), events)
    return stores.current_cases(spark, path, events).select("repo", "owner", "repo_url", "status")


@query(f"""{_R} SELECT id, target, 'sentrymill scan complete: ' || target || ' — ' || total || ' findings' AS text,
   ':red_circle: Critical: *' || critical || '*  :large_orange_circle: High: *' || high || '*  :large_yellow_circle: Medium: *' || medium || '*  :large_blue_circle: Low: *' || low || '*' AS line,
   '{{"event":"scan_complete","target":"' || target || '","counts":{{"CRITICAL":' || critical || ',"HIGH":' || high || ',"MEDIUM":' || medium || ',"LOW":' || low || '}},"total":' || total || '}}' AS body FROM scan_runs""")
def run_summaries(spark, d):
    return exports.summary_payload(views.scan_runs(spark, d))


_RESCAN = duck.with_(duck.MANIFESTS, duck.PACKAGES, duck.ADVISORIES, duck.VULNERABLE, duck.RUNS, """
now_fp AS (SELECT DISTINCT repo AS target, substr(sha1(concat('dep|', package, '|', version, '|', vuln_id)), 1, 12) AS id FROM dep_f),
scanned AS (SELECT DISTINCT repo AS target FROM manifests),
old_fp AS (SELECT DISTINCT target, id FROM cur WHERE target IN (SELECT target FROM scanned)),
both_fp AS (SELECT coalesce(n.target, o.target) AS target, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'fixed' ELSE 'unchanged' END AS state
   FROM now_fp n FULL JOIN old_fp o ON n.target = o.target AND n.id = o.id),
st AS (SELECT target, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'fixed') AS fixed, count(*) FILTER (state = 'unchanged') AS unchanged FROM both_fp GROUP BY target),
ct AS (SELECT repo AS target, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
   count(*) FILTER (severity = 'LOW') AS low, count(*) AS total FROM dep_f GROUP BY repo)""")


@query(f"""{_RESCAN} SELECT target, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total, 0) AS total,
   coalesce(new, 0) AS new, coalesce(fixed, 0) AS fixed, coalesce(unchanged, 0) AS unchanged, target IN (SELECT target FROM ranked WHERE rn = 1) AS baseline_existed
   FROM scanned LEFT JOIN ct USING (target) LEFT JOIN st USING (target)""")
def rescan(spark, d):
    from sentrymill.plans import rescan as plan
    files = views.manifests(spark, d)
    found = scan.scan(files, ("deps",), _advisories(spark, d), use_default_ignores=False, ignore_file=None)
    targets = files.select(F.col("repo").alias("target")).distinct()
    return plan.compared(targets, durable(found), views.scan_runs(spark, d), views.run_fingerprints(spark, d))[0]


@query("""WITH a AS (SELECT 'org/app-' || o_orderkey AS full_name, 'https://github.com/org/app-' || o_orderkey AS url, 'org' AS owner, 'github' AS source FROM orders),
   b AS (SELECT coalesce(CASE WHEN c_custkey % 3 <> 0 THEN 'team/' || c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_name END, '') AS full_name,
     coalesce(CASE WHEN c_custkey % 5 <> 0 THEN 'https://gitlab.com/' || c_name END, '') AS url, CASE WHEN c_custkey % 4 <> 0 THEN 'team' ELSE '' END AS owner, 'gitlab' AS source FROM customer)
   SELECT * FROM a UNION ALL SELECT * FROM b""")
def repository_feeds(spark, d):
    n = F.col("o_orderkey").cast("string")
    items = views.table(spark, d, "orders", "o_orderkey").select(
        F.concat(F.lit("org/app-"), n).alias("full_name"), F.concat(F.lit("https://github.com/org/app-"), n).alias("html_url"),
        F.struct(F.lit("org").alias("login")).alias("owner"))
    k, name = F.col("c_custkey"), F.col("c_name")
    projects = views.table(spark, d, "customer", "c_custkey", "c_name").select(
        F.when(k % 3 != 0, F.concat(F.lit("team/"), name)).alias("path_with_namespace"), F.when(k % 2 == 0, name).alias("name"),
        F.when(k % 5 != 0, F.concat(F.lit("https://gitlab.com/"), name)).alias("web_url"),
        F.when(k % 4 != 0, F.struct(F.lit("team").alias("path"))).alias("namespace"))
    return cases.normalised_feeds(items, projects)
