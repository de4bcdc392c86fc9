"""The registered queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.fixed_values import packages as P
from sentrymill.functions.suppress import scopes, suppressed
from sentrymill.functions.text import decode
from sentrymill.operators import advisories, bumps, classify, hygiene, ignore, line_scan, manifests, match, secrets
from sentrymill.operators.lines import lines
from sentrymill.session import durable, tune
from workloads import duck, planted, views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__

        def run(spark, sf_dir):
            return fn(tune(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return register


def _files(spark, sf_dir) -> DataFrame:
    return classify.classified(views.files(spark, sf_dir))


_W = duck.with_(duck.FILES, duck.FILE_KINDS, duck.CODE_ALL)


@query(f"{_W} SELECT {duck.FINDING} FROM code_f")
def code_findings(spark, d):
    return match.code_findings(_files(spark, d))


@query(f"""{_W} SELECT repo, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, count(*) AS total FROM code_f GROUP BY repo""")
def code_severity_counts(spark, d):
    found = match.code_findings(_files(spark, d))
    return (found.groupBy("repo").agg(*schema.severity_counts(F.col("severity")), F.count("*").alias("total"))
            .orderBy(F.desc("critical"), F.desc("high"), F.desc("medium"), F.desc("low"), "repo"))


@query(f"{_W} SELECT {duck.FINDING} FROM docker_f")
def docker_findings(spark, d):
    return match.docker_findings(_files(spark, d))


@query(f"{_W} SELECT {duck.FINDING} FROM iac_f")
def iac_findings(spark, d):
    return match.iac_findings(_files(spark, d))


@query(f"{_W} SELECT {duck.FINDING} FROM ci_f")
def workflow_findings(spark, d):
    return match.workflow_findings(_files(spark, d))


# --- ignore rules, suppression, hygiene, secrets ---------------------------------------------

_IGNORED = f"""SELECT repo, path,
   (regexp_matches(path, '^(?:examples(?:/.*)?|(?:.*/)?[^/]*\\.min\\.js)$')
    OR (dot = {duck.q(planted.IGNORE_FILES[1])} AND ends_with(path, '.php'))
    OR (dot = {duck.q(planted.IGNORE_FILES[2])} AND (starts_with(path, 'infra/') OR regexp_matches(path, '^(.*/)?app_[^/]\\.js$')
        OR regexp_matches(path, '^core/[^/]*\\.java$')))) AS ignored
   FROM files LEFT JOIN (SELECT repo, content AS dot FROM files WHERE path = '{ignore.IGNORE_FILE}') USING (repo)"""


@query(duck.with_(duck.FILES) + _IGNORED)
def ignored_paths(spark, d):
    return ignore.flagged(views.files(spark, d)).select("repo", "path", "ignored")


@query(duck.with_(duck.FILES) + f"""SELECT repo, path, line_no, array_to_string(list_sort({duck.scope_list()}), ',') AS scopes,
   {duck.suppressed('code')} AS code, {duck.suppressed('secret')} AS secret, {duck.suppressed('dep')} AS dep
   FROM {duck.lines_of('files')} WHERE regexp_matches(line, '(?i)(?:#|//|/\\*|<!--)\\s*nosec\\b')""")
def suppressed_lines(spark, d):
    marked = lines(views.files(spark, d)).withColumn("_s", scopes(F.col("line"))).where(F.col("_s").isNotNull())
    return marked.select("repo", "path", "line_no", F.array_join(F.array_sort("_s"), ",").alias("scopes"),
                         *[suppressed(F.col("line"), s).alias(s) for s in ("code", "secret", "dep")])


@query(duck.with_(duck.FILES) + f"""SELECT repo, path, line_no, line FROM {duck.lines_of('files')} l
   WHERE NOT (line = '' AND line_no = (SELECT len(string_split(content, chr(10))) FROM files f WHERE f.repo = l.repo AND f.path = l.path))""")
def file_lines(spark, d):
    return lines(views.files(spark, d), keep_empty=True).select("repo", "path", "line_no", "line")


# a rule set of a user's own, written out in the SQL as well
_USER_RULES = [("Opening question", "style", "LOW", r"(?i)^the\b.*\bof\b", "A line that begins so.", ("the",)),
               ("Long number", "style", "MEDIUM", r"\b[0-9]{16}\b", "A number of sixteen digits.", ())]


@query(duck.with_(duck.FILES, duck.FILE_KINDS) + rf"""SELECT repo, path, line_no,
     CASE WHEN regexp_matches(line, '(?i)^the\b.*\bof\b') THEN 'Opening question' ELSE 'Long number' END AS issue_type,
     CASE WHEN regexp_matches(line, '(?i)^the\b.*\bof\b') THEN 'LOW' ELSE 'MEDIUM' END AS severity
   FROM {duck.lines_of('kinds', where="file_kind = 'code'")}
   WHERE regexp_matches(line, '(?i)^the\b.*\bof\b|\b[0-9]{{16}}\b') AND NOT {duck.suppressed('code')}""")
def user_rule_findings(spark, d):
    return match.line_findings(_files(spark, d), {"code": _USER_RULES}).select("repo", "path", "line_no", "issue_type", "severity")


# a thousand rules, one for each three syllables that a word may begin with
_SYLLABLES = ["th", "he", "in", "er", "an", "re", "nd", "on", "en", "at"]
_MANY_RULES = [(f"Word {a}{b}{c}", "style", "LOW", rf"\b{a}{b}{c}[a-z]*ing\b", "A word that begins so and ends in ing.", (a + b + c,))
               for a in _SYLLABLES for b in _SYLLABLES for c in _SYLLABLES]


@query(duck.with_(duck.FILES) + rf"""SELECT repo, path, line_no, 'Word ' || {_SYLLABLES}[r // 100 + 1] || {_SYLLABLES}[r // 10 % 10 + 1] || {_SYLLABLES}[r % 10 + 1] AS issue_type
   FROM (SELECT *, list_min(list_transform(regexp_extract_all(line, '\b(?:{"|".join(_SYLLABLES)}){{3}}[a-z]*ing\b'), lambda w:
     100 * list_position({_SYLLABLES}, substr(w, 1, 2)) + 10 * list_position({_SYLLABLES}, substr(w, 3, 2)) + list_position({_SYLLABLES}, substr(w, 5, 2)) - 111)) AS r
     FROM {duck.lines_of('files')}) WHERE r IS NOT NULL AND NOT {duck.suppressed('code')}""")
def thousand_rule_findings(spark, d):
    return line_scan.indexed_findings(views.files(spark, d), _MANY_RULES).select("repo", "path", "line_no", "issue_type")


@query("""SELECT 'doc-' || doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN left(text, 5) || chr(65533) || substr(text, 6) ELSE text END) AS content_sha256,
     doc_id % 3 <> 0 AS valid_utf8 FROM documents""")
def decoded_files(spark, d):
    return views.file_bytes(spark, d).select("path", F.sha2(decode(F.col("content")), 256).alias("content_sha256"),
                                             F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"))


@query(duck.with_(duck.FILES, duck.secret_ctes("files")) + """SELECT repo, path, line_no, secret_type, matched_value
   FROM secret_f WHERE NOT contains(lower(value), '7')""")
def allowed_secrets(spark, d):
    found = secrets.secret_findings(views.files(spark, d), allow_words=["7"])
    return found.select("repo", "path", "line_no", "secret_type", "matched_value")


_HYG = """sens AS (SELECT DISTINCT repo, CASE WHEN regexp_matches(path, '(^|/)\\.env$') THEN '.env' WHEN ends_with(path, '.pem') THEN '*.pem'
   WHEN ends_with(path, '/id_rsa') THEN 'id_rsa' END AS kind FROM files),
gi AS (SELECT repo, trim(line) AS e FROM (SELECT repo, unnest(string_split(lower(content), chr(10))) AS line FROM files WHERE path = '.gitignore')
   WHERE NOT starts_with(line, '#') AND trim(line) <> '')"""
_HYG_SELECT = """SELECT repo, '.gitignore' AS path, 0 AS line_no, 'Sensitive file type not git-ignored: ' || kind AS issue_type,
   'hygiene' AS category, 'MEDIUM' AS severity, 'Files matching ''' || kind || ''' are present but not covered by .gitignore — they risk being committed. Add an ignore rule.' AS description,
   '' AS context FROM sens s WHERE kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gi WHERE gi.repo = s.repo
     AND (contains(e, ltrim(kind, '*')) OR contains(kind, ltrim(e, '*'))))"""


@query(duck.with_(duck.FILES, _HYG) + _HYG_SELECT)
def gitignore_hygiene(spark, d):
    return hygiene.gitignore_findings(views.files(spark, d))


@query(duck.with_(duck.FILES, duck.secret_ctes("files")) + "SELECT * EXCLUDE (value) FROM secret_f")
def secret_findings_masked(spark, d):
    return secrets.secret_findings(ignore.visible(views.files(spark, d), use_defaults=False, ignore_file=None))


@query(duck.with_(duck.VERSIONS, duck.secret_ctes("file_versions", "repo, path, commit", "past_"),
                  duck.secret_ctes("current_files", "repo, path", "now_")) + """
   SELECT p.* EXCLUDE (value) FROM past_secret_f p WHERE NOT EXISTS (SELECT 1 FROM now_secret_f n WHERE n.repo = p.repo
     AND n.path = p.path AND n.secret_type = p.secret_type AND n.value = p.value)""")
def history_only_secrets(spark, d):
    versions = views.file_versions(spark, d)
    return secrets.history_findings(versions, views.current_files(versions))


# --- packages, advisories, licences, upgrades ------------------------------------------------

_P = duck.with_(duck.MANIFESTS, duck.PACKAGES)
_PA = duck.with_(duck.MANIFESTS, duck.PACKAGES, duck.ADVISORIES, duck.VULNERABLE, duck.BUMPS)
_PACKAGE = "repo, file, package, version, ecosystem"


def _register_packages(label: str, names: list[str], cte: str) -> None:
    extractors = {n: manifests.EXTRACTORS[n] for n in names}

    @query(f"{_P} SELECT {_PACKAGE} FROM {cte}", name=f"packages_{label}")
    def run(spark, d):
        return manifests.packages(views.manifests(spark, d), extractors)


_register_packages("requirements", ["requirements.txt"], "pk_req")
_register_packages("npm", ["package.json"], "pk_npm")
_register_packages("go", ["go.mod"], "pk_go")
_register_packages("gem", ["Gemfile.lock"], "pk_gem")
_register_packages("composer", ["composer.lock"], "pk_composer")
_register_packages("toml", ["Cargo.lock", "poetry.lock"], "pk_toml")


def _declared(spark, d) -> DataFrame:
    return manifests.packages(views.manifests(spark, d))


def _advisories(spark, d) -> DataFrame:
    return advisories.parsed(views.advisory_documents(spark, d))


@query(f"{_P} SELECT ecosystem, count(*) AS declarations, count(DISTINCT package || '@' || version) AS coordinates FROM packages GROUP BY 1")
def packages_all(spark, d):
    once_each = _declared(spark, d).groupBy("ecosystem", "package", "version").agg(F.count("*").alias("n"))
    return once_each.groupBy("ecosystem").agg(F.sum("n").alias("declarations"), F.count("*").alias("coordinates"))


_PURL = ("'pkg:' || CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang' WHEN 'RubyGems' THEN 'gem' "
         "WHEN 'Packagist' THEN 'composer' WHEN 'crates.io' THEN 'cargo' ELSE lower(ecosystem) END || '/' || name || '@' || version")


@query(f"{_P} SELECT *, {_PURL} AS purl FROM (SELECT repo, ecosystem, package AS name, version, min(file) AS file FROM packages GROUP BY ALL)")
def sbom_components(spark, d):
    return manifests.components(_declared(spark, d))


@query(f"""{_P} SELECT ecosystem, package, version, (row_number() OVER (ORDER BY ecosystem, package, version) - 1) // 100 AS batch
   FROM (SELECT DISTINCT ecosystem, package, version FROM packages)""")
def lookup_batches(spark, d):
    return manifests.lookup_batches(_declared(spark, d), P.LOOKUP_BATCH)


@query(f"{_PA} SELECT * FROM dep_f")
def vulnerable_dependencies(spark, d):
    return advisories.dependency_findings(_declared(spark, d), _advisories(spark, d))


# what a range holds follows from the numbers that the versions were made of
@query("""
WITH i AS (SELECT l_orderkey, l_partkey, l_linenumber % 6 AS x, l_quantity::INT % 9 AS y, p_size % 5 AS a, p_partkey % 7 AS b, p_partkey % 8 AS kind
   FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'repo-' || l_orderkey AS repo, 'shape-' || l_partkey AS package, 'SHP-' || l_partkey AS vuln_id,
   CASE kind WHEN 0 THEN 'v0.0.0-2020010' || x || '10101' || y || '-ffffffffffff'
     WHEN 1 THEN CASE WHEN x > 0 THEN x || '!' ELSE '' END || y || '.0.0'
     WHEN 2 THEN CASE x WHEN 0 THEN '1.0' WHEN 1 THEN '1.0-' || y ELSE '1.0.post' || y END
     WHEN 3 THEN CASE WHEN x = 0 THEN '1.0.0' ELSE '1.0.0-' || x || '.' || y END
     WHEN 4 THEN x || '.' || y WHEN 6 THEN '1.' || x || '.rc' || y
     ELSE '1.0-' || CASE x WHEN 0 THEN 'RC' ELSE 'beta' END || y END AS version
FROM i WHERE CASE kind WHEN 0 THEN (x, y) < (a, b) WHEN 1 THEN (x, y) < (a, b) WHEN 2 THEN x = 0 OR y < b
   WHEN 3 THEN x > 0 AND (x, y) >= (a, 3) WHEN 4 THEN (x, y) >= (a, 0) AND NOT (a <= b AND (x, y) >= (b, 5))
   WHEN 6 THEN (x, y) <= (a, b) WHEN 7 THEN x > 0 AND y < 10 + b ELSE false END""")
def version_shapes(spark, d):
    found = advisories.matched(views.shaped_packages(spark, d), advisories.parsed(views.shaped_advisories(spark, d)))
    return found.select("repo", "package", "vuln_id", "version")


@query(duck.with_(duck.ADVISORIES) + "SELECT vuln_id, severity, summary, fixed_version FROM advisories")
def advisory_severity(spark, d):
    return advisories.summarised(_advisories(spark, d)).drop("affected")


_LIC = duck.with_(duck.MANIFESTS, duck.PACKAGES, duck.LICENCES, """
named AS (SELECT *, CASE WHEN len(licenses) > 0 THEN licenses[1] WHEN licenses IS NOT NULL THEN 'UNKNOWN' END AS raw FROM licences),
license_f AS (SELECT p.repo, p.file, p.package, p.version, p.ecosystem, CASE WHEN raw = '' THEN 'UNKNOWN' ELSE raw END AS license,
   CASE WHEN trim(raw) IN ('', 'UNKNOWN', 'NOASSERTION', 'NONE') THEN 'LOW' WHEN regexp_matches(trim(raw), '^A?GPL-') THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
   CASE WHEN trim(raw) IN ('', 'UNKNOWN', 'NOASSERTION', 'NONE') THEN 'No license metadata found — verify usage rights manually.'
        WHEN regexp_matches(trim(raw), '^A?GPL-') THEN trim(raw) || ' is a strong copyleft license — may require releasing source of derivative/linked works.'
        ELSE trim(raw) || ' is a weak copyleft / reciprocal license — review obligations for modifications and distribution.' END AS reason
   FROM packages p JOIN named n ON p.ecosystem = n.ecosystem AND p.package = n.package AND p.version = n.version
   WHERE regexp_matches(trim(raw), '^((A?GPL|LGPL|MPL|EPL|CDDL)-.*|UNKNOWN|NOASSERTION|NONE|)$'))""")


@query(f"{_LIC} SELECT * FROM license_f")
def license_findings(spark, d):
    return advisories.licence_findings(_declared(spark, d), views.licence_feed(spark, d))


@query(f"{_LIC} SELECT raw AS license, count(*) AS coordinates FROM named GROUP BY 1")
def licence_lookup(spark, d):
    feed = views.licence_feed(spark, d)
    name = F.when(F.size("licenses") > 0, F.element_at("licenses", 1)).when(F.col("licenses").isNotNull(), "UNKNOWN")
    return feed.groupBy(name.alias("license")).agg(F.count("*").alias("coordinates"))


def _bumps(spark, d) -> DataFrame:
    return bumps.plan(vulnerable_dependencies(spark, d))


@query(f"{_PA} SELECT * FROM bumps")
def bump_plan(spark, d):
    return _bumps(spark, d)


@query(rf"""{_PA}, fixes AS (SELECT m.repo, m.file, m.mid, line_no, line,
     CASE WHEN b.new_version IS NOT NULL AND NOT regexp_matches(trim(line), '^(#|-|git\+)|://')
          THEN regexp_extract(line, '^(\s*)([A-Za-z0-9][A-Za-z0-9_.\-]*)(\[[^\]]*\])?', 0) || '>=' || b.new_version ELSE line END AS fixed
   FROM mlines m LEFT JOIN bumps b ON b.repo = m.repo AND b.file = m.file
     AND b.package_key = replace(lower(regexp_extract(line, '^\s*([A-Za-z0-9][A-Za-z0-9_.\-]*)', 1)), '_', '-')
   WHERE m.fmt = 0 AND (m.repo, m.file) IN (SELECT repo, file FROM bumps))
   SELECT repo, file AS path, string_agg(fixed, chr(10) ORDER BY line_no) AS content FROM fixes GROUP BY repo, file, mid""")
def manifest_rewrite(spark, d):
    return bumps.requirements_edits(views.manifests(spark, d), _bumps(spark, d))


@query(rf"""{_PA}, planned AS (SELECT repo, file, list(package || '|' || new_version) AS fixes FROM bumps GROUP BY repo, file)
   SELECT m.repo, m.file AS path, list_reduce(list_concat([content], fixes), lambda text, x:
     regexp_replace(text, '("' || split_part(x, '|', 1) || '"\s*:\s*)"[^"]*"', '\1"^' || split_part(x, '|', 2) || '"', 'g')) AS content
   FROM manifests m JOIN planned p ON p.repo = m.repo AND p.file = m.file WHERE fmt = 1""")
def npm_manifest_rewrite(spark, d):
    return bumps.package_json_rewrites(views.manifests(spark, d), _bumps(spark, d))


_SPECS = """specs AS (SELECT DISTINCT target, CASE WHEN pre = '' THEN 'PyPI' WHEN pre IN ('pip:') THEN 'PyPI' WHEN pre = 'npm:' THEN 'npm'
   WHEN pre = 'go:' THEN 'Go' WHEN pre = 'gem:' THEN 'RubyGems' WHEN pre = 'composer:' THEN 'Packagist' ELSE 'crates.io' END AS ecosystem, package, version
   FROM (SELECT *, pre || package || '@' || version AS target FROM (SELECT ['', 'pip:', 'npm:', 'go:', 'gem:', 'composer:', 'Cargo:', 'crates.io:'][l_orderkey % 8 + 1] AS pre,
     'pkg-' || l_partkey AS package, l_quantity::INT || '.' || l_linenumber AS version FROM lineitem)))"""


@query(duck.with_(duck.ADVISORIES, _SPECS) + f"""SELECT target, severity, vuln_id AS title,
     CASE WHEN summary = 'No summary available.' THEN '' ELSE summary END || coalesce(' — fixed in ' || fixed_version, '') AS detail
   FROM specs JOIN advisories a USING (ecosystem, package) WHERE {duck.in_range('version')}""")
def package_lookup(spark, d):
    return advisories.package_lookup(views.package_specs(spark, d), _advisories(spark, d))


@query("""WITH c AS (SELECT 'CVE-2024-' || lpad(p_partkey::VARCHAR, 9, '0') AS cve_id, p_name || ' in ' || p_type AS detail,
     coalesce(CASE WHEN p_partkey % 4 = 0 THEN p_size / 5.0::DOUBLE END, CASE WHEN p_partkey % 3 = 0 THEN p_size / 6.0::DOUBLE END,
              CASE WHEN p_partkey % 2 = 0 THEN p_size / 7.0::DOUBLE END) AS s FROM part),
   words AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS keyword FROM part UNION SELECT 'b' UNION SELECT ' ring '),
   hit AS (SELECT * FROM c JOIN words ON contains(lower(detail), trim(lower(keyword))))
   SELECT keyword, cve_id, CASE WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' WHEN s IS NOT NULL THEN 'LOW' ELSE 'MEDIUM' END AS severity,
     detail, count(*) OVER (PARTITION BY keyword) AS total FROM hit""")
def cve_search(spark, d):
    return advisories.cve_search(views.cves(spark, d), views.cve_keywords(spark, d))
