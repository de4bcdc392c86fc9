"""Registered queries over observations: the posture checks and their registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values import posture as V
from sentrymill.functions.network import resolves_public
from sentrymill.operators import advisories, checks
from sentrymill.plans import registry
from workloads import duck, views
from workloads.queries import _SPECS, ORACLE, query

_H = duck.with_(duck.HTTP)
_ORDER = ["check_id", "target", "severity", "title", "detail"]
_COLS = ", ".join(_ORDER)
q = duck.q


def _now() -> F.Column:
    return views.at(views.NOW)


_PRESENT = {"strict-transport-security": "hsts IS NOT NULL", "content-security-policy": "csp", "x-content-type-options": "xcto",
            "x-frame-options": "xfo", "referrer-policy": "referrer", "permissions-policy": "permissions"}
_WEBSITE = [("NOT starts_with(final_url, 'https://')", "'HIGH'", "'Site not served over HTTPS'",
             q("Traffic is unencrypted — enable TLS and redirect HTTP to HTTPS."))]
_WEBSITE += [(f"NOT ({_PRESENT[h]})", q(s), q(t), q(x)) for h, s, t, x in V.SECURITY_HEADERS]
_WEBSITE += [("server = 'nginx/1.18.0'", "'LOW'", "'Server version disclosed'", "'Server: ' || server"),
             ("powered IS NOT NULL", "'LOW'", "'Technology disclosed'", "'X-Powered-By: ' || powered"),
             ("len(list_filter(cookies, lambda c: NOT contains(lower(c), 'secure'))) > 0", "'MEDIUM'", "'Cookie without Secure flag'",
              "'A cookie may be sent over plain HTTP.'"),
             ("len(list_filter(cookies, lambda c: NOT contains(lower(c), 'httponly'))) > 0", "'LOW'", "'Cookie without HttpOnly flag'",
              "'A cookie is readable by JavaScript (XSS risk).'")]
_WEBSITE_SQL = duck.union_rules("http_obs", "website", "final_url", _WEBSITE) + " UNION ALL " + duck.union_rules(
    "(SELECT final_url, days FROM http_obs JOIN tls_obs USING (host) WHERE starts_with(final_url, 'https://'))", "website", "final_url", duck.EXPIRY)


@query(f"{_H} {_WEBSITE_SQL}")
def header_posture(spark, d):
    return checks.website(views.http_obs(spark, d), views.tls_obs(spark, d), _now())


@query(f"""{_H}, n AS (SELECT final_url AS target, {' + '.join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _PRESENT.values())} AS present FROM http_obs),
   g AS (SELECT *, CASE WHEN present >= 6 THEN 'A' WHEN present >= 5 THEN 'B' WHEN present >= 4 THEN 'C' WHEN present >= 2 THEN 'D' ELSE 'F' END AS grade FROM n)
   SELECT target, present, grade, 'Security header grade: ' || grade || ' (' || present || '/6 headers, ' || CASE WHEN starts_with(target, 'https') THEN 'HTTPS' ELSE 'no HTTPS' END || ')' AS summary FROM g""")
def header_grades(spark, d):
    return checks.header_grades(views.http_obs(spark, d))


_CK = "(SELECT host, trim(string_split(c, '=')[1]) AS name, lower(c) AS low FROM (SELECT host, unnest(cookies) AS c FROM http_obs))"


@query(f"{_H} " + duck.union_rules(_CK, "cookies", "host", [
    ("NOT contains(low, 'secure')", "'MEDIUM'", "'Cookie ''' || name || ''' missing Secure'", "'May be transmitted over plain HTTP.'"),
    ("NOT contains(low, 'httponly')", "'LOW'", "'Cookie ''' || name || ''' missing HttpOnly'", "'Readable by JavaScript — XSS can steal it.'"),
    ("NOT contains(low, 'samesite')", "'LOW'", "'Cookie ''' || name || ''' missing SameSite'", "'Set SameSite=Lax or Strict to mitigate CSRF.'"),
    ("contains(low, 'samesite=none') AND NOT contains(low, 'secure')", "'MEDIUM'", "'Cookie ''' || name || ''' SameSite=None without Secure'",
     "'SameSite=None requires the Secure attribute.'")]))
def cookie_flags(spark, d):
    return checks.cookies(views.http_obs(spark, d))


@query(f"{_H} " + duck.union_rules("http_obs", "cors", "url", [
    (f"acao = '{views.PROBE_ORIGIN}' AND acac", "'HIGH'", "'CORS reflects any origin with credentials'",
     q("Access-Control-Allow-Origin echoes the request Origin AND allows credentials — any site can read authenticated responses.")),
    (f"acao = '{views.PROBE_ORIGIN}' AND NOT acac", "'MEDIUM'", "'CORS reflects any origin'",
     q("Access-Control-Allow-Origin echoes the request Origin — restrict it to known domains.")),
    ("acao = '*'", "'LOW'", "'CORS allows all origins (*)'", "'Fine for public data, risky for anything authenticated.'")]))
def cors_policy(spark, d):
    return checks.cors(views.http_obs(spark, d))


def _plain_and_secure(spark, d, per_host: bool = False) -> tuple[DataFrame, DataFrame]:
    """One plain and one TLS observation per page, which the page id keeps apart, or those of the first page of each host."""
    pages = views.http_obs(spark, d).select("page_id", "host", "status", "location", "headers")
    host = F.concat_ws("#", "host", F.col("page_id").cast("string")).alias("host")
    if per_host:
        first = pages.groupBy("host").agg(F.min("page_id").alias("page_id"))
        pages, host = pages.join(first, ["host", "page_id"]), F.col("host")
    p = F.col("page_id")
    plain = pages.select(host, "status", "location", F.when(p % 11 == 0, "timed out").alias("error"))
    secure = pages.select(host, F.try_element_at("headers", F.lit("Strict-Transport-Security")).alias("hsts"),
                          F.when(p % 13 == 0, "refused").alias("error"))
    return plain, secure


_RD = """(SELECT host || '#' || page_id AS host, status, coalesce(location, '') AS location, coalesce(hsts, '') AS hsts, page_id % 11 <> 0 AS ok, page_id % 13 <> 0 AS sok,
   CASE WHEN contains(hsts, 'max-age=31536000') THEN 31536000 WHEN contains(hsts, 'max-age=300') THEN 300 ELSE 0 END AS age FROM http_obs)"""


_REDIRECT = [
    ("ok AND status BETWEEN 300 AND 399 AND NOT starts_with(location, 'https://')", "'MEDIUM'", "'HTTP redirects, but not to HTTPS'",
     "'HTTP responded ' || status || ' to ' || CASE location WHEN '' THEN '(no Location)' ELSE location END || '.'"),
    ("ok AND status = 200", "'HIGH'", "'HTTP served directly (no HTTPS redirect)'", "'Plain HTTP returns content instead of redirecting to HTTPS.'"),
    ("NOT ok", "'LOW'", "'Could not reach site over HTTP'", "'timed out'"),
    ("sok AND hsts = ''", "'MEDIUM'", "'No HSTS header'", "'Add Strict-Transport-Security to force HTTPS on future visits.'"),
    ("sok AND hsts <> '' AND age < 15552000", "'LOW'", "'HSTS max-age below preload threshold'",
     "'max-age=' || age || '; use ≥15552000 (180d) for HSTS preload eligibility.'"),
    ("sok AND hsts <> '' AND NOT contains(lower(hsts), 'includesubdomains')", "'LOW'", "'HSTS missing includeSubDomains'",
     "'Add includeSubDomains so subdomains are also protected.'"),
    ("sok AND hsts <> '' AND NOT contains(lower(hsts), 'preload')", "'LOW'", "'HSTS not preload-ready'",
     "'Add the preload directive and submit to hstspreload.org.'"),
    ("NOT sok", "'LOW'", "'Could not reach site over HTTPS'", "'refused'")]


@query(f"{_H} " + duck.union_rules(_RD, "https-redirect", "host", _REDIRECT))
def https_redirect(spark, d):
    return checks.https_redirect(*_plain_and_secure(spark, d))


@query(rf"""{_H}, quoted AS (SELECT page_id, host, unnest(list_concat(regexp_extract_all(b, {q(V.MIXED_ATTRIBUTE)}), regexp_extract_all(b, {q(V.MIXED_ASSET)}))) AS x
     FROM (SELECT page_id, host, body AS b FROM http_obs WHERE status = 200 AND starts_with(lower(final_url), 'https://'))),
   urls AS (SELECT DISTINCT page_id, host, unnest(regexp_extract_all(x, {q(V.MIXED_URL)})) AS u FROM quoted)
   SELECT 'mixed-content' AS check_id, host AS target, 'MEDIUM' AS severity, 'Insecure (HTTP) resource on HTTPS page' AS title,
     u || ' — browsers may block it or warn; load it over HTTPS.' AS detail FROM urls""")
def mixed_content(spark, d):
    return checks.mixed_content(views.http_obs(spark, d))


@query(f"{_H} " + duck.union_rules("hosts", "security-txt", "host", [
    ("m > 2 AND x > 1", "'LOW'", "'No security.txt (RFC 9116)'", "'Add /.well-known/security.txt so researchers can reach you.'"),
    ("m = 0", "'LOW'", "'security.txt present but missing Contact field'", "'RFC 9116 requires a Contact field.'")]))
def security_txt(spark, d):
    return checks.security_txt(views.security_txt_obs(spark, d))


@query(f"""{_H}, probes AS (SELECT *, 'https://' || host || '/' || page_id AS base FROM http_obs, {duck.values(
    [(0, '/.git/HEAD', 'REF: refs/heads/main', 'ref:'), (1, '/.env', 'A=1', '='), (2, '/.svn/entries', '', ''), (3, '/.DS_Store', 'x', ''),
     (4, '/.aws/credentials', '[default]', 'aws_'), (5, '/server-status', 'apache status', 'apache'), (6, '/backup.zip', 'PK', '')], 'i, path, text, marker')})
   SELECT 'exposed-files' AS check_id, base AS target, 'HIGH' AS severity, 'Exposed: ' || path AS title, 'Publicly accessible — block or remove it.' AS detail
   FROM probes WHERE (page_id + i) % 3 = 0 AND contains(lower(text), marker)""")
def exposed_files(spark, d):
    return checks.exposed_files(views.exposed_obs(spark, d))


@query(f"""{_H}, probes AS (SELECT url, param, j, page_id + i * 3 + j AS k FROM http_obs, {duck.values(list(enumerate(V.REDIRECT_PARAMS)), 'i, param')}, (VALUES (0), (1)) p(j)),
   hit AS (SELECT url, param, arg_min(CASE WHEN k % 5 = 0 THEN 302 ELSE 307 END, j) AS status FROM probes WHERE k % 5 <= 1 AND k % 2 = 0 GROUP BY url, param)
   SELECT 'open-redirect' AS check_id, url AS target, 'MEDIUM' AS severity, 'Open redirect via ''' || param || ''' parameter' AS title,
     'Request with ?' || param || '=<external URL> returned a ' || status || ' redirect to an attacker-controlled host. Validate redirect targets against an allowlist.' AS detail FROM hit""")
def open_redirect(spark, d):
    return checks.open_redirect(views.redirect_obs(spark, d))


@query(f"{_H} " + duck.union_rules("hosts", "dns", "host", [
    ("m > 3", "'MEDIUM'", "'No SPF record'", "'Add an SPF TXT record to curb email spoofing.'"),
    ("m = 3", "'HIGH'", "'SPF allows all senders (+all)'", "'Tighten the policy to ~all or -all.'"),
    ("x > 1", "'MEDIUM'", "'No DMARC record'", "'Add a _dmarc TXT record (start at p=none).'"),
    ("x = 0", "'LOW'", "'DMARC policy is p=none'", "'Move to p=quarantine or p=reject when ready.'"),
    ("m % 2 <> 0", "'LOW'", "'DNSSEC not validated'", "'Responses are not DNSSEC-signed/validated.'"),
    ("m = 4", "'LOW'", "'No MX records'", "'No mail servers configured for this domain.'")]))
def dns_posture(spark, d):
    return checks.dns_health(views.dns_obs(spark, d))


@query(f"{_H} " + duck.union_rules("hosts", "caa", "host", [
    ("x <> 2", "'LOW'", "'No CAA record'", q("Without CAA, any certificate authority can issue certs for this domain. Add a CAA record to restrict it."))]))
def caa_records(spark, d):
    return checks.caa(views.dns_obs(spark, d))


@query(f"""{_H} SELECT host AS target, CASE WHEN x = 2 THEN '2 CAA record(s): 0 issue "a.example"; 0 issue "b.example"' ELSE 'No CAA records found.' END AS summary FROM hosts""")
def caa_summaries(spark, d):
    return checks.caa_summary(views.dns_obs(spark, d))


@query(f"{_H} " + duck.union_rules("tls_obs", "tls", "host", [
    ("tls10", "'HIGH'", "'TLS 1.0 is supported (deprecated)'", "'Disable TLS 1.0; serve TLS 1.2+ only.'"),
    ("tls11", "'MEDIUM'", "'TLS 1.1 is supported (deprecated)'", "'Disable TLS 1.1; serve TLS 1.2+ only.'"), *duck.EXPIRY]))
def tls_expiry(spark, d):
    return checks.tls(views.tls_obs(spark, d), _now())


@query(f"{_H} SELECT host AS target, 'Issuer: ' || coalesce(issuer, '?') || '; certificate valid for ' || days || ' more day(s).' AS summary FROM tls_obs")
def tls_summaries(spark, d):
    return checks.tls_summary(views.tls_obs(spark, d), _now())


_RDAP = f"""rd AS (SELECT host, m, x, n, TIMESTAMP '{views.NOW}' - (n + 31) * 40 * INTERVAL 1 HOUR AS reg, TIMESTAMP '{views.NOW}' + (n * 24 + x * 6) * INTERVAL 1 HOUR AS exp,
   floor((n + 31) * 40 / 24.0)::INT AS age, floor(-(n * 24 + x * 6) / 24.0)::INT AS past FROM hosts)"""


@query(f"{_H}, {_RDAP} " + duck.union_rules("rd", "rdap", "host", [
    ("m <> 5 AND age < 90", "'MEDIUM'", "'Recently registered domain'", "'Registered ' || age || ' day(s) ago — a common phishing indicator.'"),
    ("m <> 0 AND past > -30", "'MEDIUM'", "'Domain expiring soon'", "(-past) || ' day(s) until expiry.'")]))
def domain_age(spark, d):
    return checks.rdap(views.rdap_obs(spark, d), _now())


@query(f"""{_H}, {_RDAP} SELECT host AS target, 'Registered ' || CASE WHEN m = 5 THEN 'unknown' ELSE strftime(reg, '%Y-%m-%dT%H:%M:%SZ') END || ', expires ' ||
   CASE WHEN m = 0 THEN '?' ELSE strftime(exp, '%Y-%m-%dT%H:%M:%SZ') END || ', registrar ' || CASE WHEN x > 0 THEN 'Registrar ' || x ELSE '?' END || '.' AS summary FROM rd""")
def domain_summaries(spark, d):
    return checks.rdap_summary(views.rdap_obs(spark, d))


_CT = r"""names AS (SELECT DISTINCT domain, name FROM (SELECT domain, ltrim(lower(trim(unnest(string_split(host || chr(10) || '*.' || upper(host) || chr(10) || 'not' || domain || chr(10) || domain
   || chr(10) || 'p' || (page_id % 400) || '.' || domain, chr(10))))), '*.') AS name FROM (SELECT *, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain FROM http_obs)) WHERE ends_with(name, '.' || domain))"""


@query(f"""{_H}, {_CT} SELECT 'subdomains' AS check_id, domain AS target, 'LOW' AS severity, name AS title, 'Subdomain found in certificate transparency logs.' AS detail
   FROM names""")
def subdomains(spark, d):
    return checks.subdomains(views.ct_entries(spark, d))


@query(f"{_H}, {_CT} SELECT domain AS target, count(*) AS total, 'Found ' || count(*) || ' unique subdomain(s) in CT logs.' AS summary FROM names GROUP BY domain")
def subdomain_totals(spark, d):
    return checks.subdomain_totals(views.ct_entries(spark, d))


_TYPO = f"""dom AS (SELECT DISTINCT regexp_replace(host, '^www\\.', '') AS domain FROM hosts),
 nt AS (SELECT domain, regexp_extract(domain, '^(.*)\\.([^.]*)$', 1) AS name, regexp_extract(domain, '^(.*)\\.([^.]*)$', 2) AS tld FROM dom),
 pos AS (SELECT *, unnest(range(1, length(name) + 1)) AS i FROM nt),
 vars AS (SELECT domain, substr(name, 1, i - 1) || substr(name, i + 1) || '.' || tld AS v FROM pos
   UNION SELECT domain, substr(name, 1, i - 1) || substr(name, i + 1, 1) || substr(name, i, 1) || substr(name, i + 2) || '.' || tld FROM pos WHERE i < length(name)
   UNION SELECT domain, substr(name, 1, i) || substr(name, i, 1) || substr(name, i + 1) || '.' || tld FROM pos
   UNION SELECT domain, name || '.' || t FROM nt, (VALUES {', '.join(f"('{t}')" for t in V.TYPO_TLDS)}) tl(t) WHERE t <> tld),
 top AS (SELECT domain, v FROM vars WHERE v <> domain AND NOT starts_with(v, '.')),
 reg AS (SELECT host AS r FROM hosts UNION SELECT regexp_extract(host, '^(.*)\\.[^.]*$', 1) || '.io' FROM hosts UNION SELECT regexp_extract(host, '^(.*)\\.[^.]*$', 1) || '.net' FROM hosts
   UNION SELECT substr(host, 2, 200) FROM hosts UNION SELECT host[1] || substr(host, 3, 200) FROM hosts UNION SELECT host[1] || host FROM hosts)"""


@query(f"""{_H}, {_TYPO} SELECT 'typosquat' AS check_id, domain AS target, 'MEDIUM' AS severity, 'Look-alike domain registered: ' || v AS title,
   'A typosquat of your domain is registered — possible phishing vector.' AS detail FROM top WHERE v IN (SELECT r FROM reg)""")
def typosquat_hits(spark, d):
    return checks.typosquat(views.domains(spark, d), views.registered_domains(spark, d))


@query("""WITH corpus AS (SELECT upper(sha1(p_name || p_size)) AS h, sum(p_partkey)::BIGINT AS n FROM part GROUP BY 1)
   SELECT 'pwned-password' AS check_id, p_partkey::VARCHAR AS target, CASE WHEN n >= 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'Password found in known breaches' AS title,
     'Seen ' || format('{:,}', n) || ' time(s) — choose a different password.' AS detail
   FROM part JOIN corpus ON h = upper(sha1(p_name || (p_size + p_partkey % 3 * 20))) WHERE n > 0""")
def pwned_passwords(spark, d):
    return checks.pwned_password(views.passwords(spark, d), views.password_corpus(spark, d))


@query("""SELECT 'breach' AS check_id, email AS target, CASE WHEN o_orderstatus = 'F' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
     'Found in breach: ' || o_orderpriority || ' (' || CASE WHEN o_custkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '?' END || ')' AS title,
     CASE o_orderstatus WHEN 'F' THEN 'Exposed data: Emails, Passwords' WHEN 'O' THEN 'Exposed data: Emails' ELSE '' END AS detail
   FROM (SELECT *, 'c' || o_custkey || '@mail' || (o_custkey % 25) || '.example.com' AS email FROM orders)
   WHERE email IN (SELECT 'c' || c_custkey || '@mail' || c_nationkey || '.example.com' FROM customer)""")
def breached_accounts(spark, d):
    return checks.breach(views.emails(spark, d), views.breaches(spark, d))


_TARGETS = _SPECS + """, targets AS (SELECT url AS target FROM pages UNION SELECT host FROM http_obs UNION SELECT 'c' || c_custkey || '@mail' || c_nationkey || '.example.com' FROM customer
   UNION SELECT target FROM specs UNION SELECT p_name FROM part),
 kinds_t AS (SELECT target, CASE WHEN regexp_matches(target, '(?i)^https?://') THEN 'url' WHEN contains(target, '@') THEN
     CASE WHEN regexp_matches(target, '^[^@]*@[0-9]') OR contains(string_split(target, '@')[1], ':') THEN 'package' WHEN regexp_matches(target, '@.*\\.') THEN 'email' ELSE 'keyword' END
   WHEN regexp_matches(target, '(?i)^[a-z0-9.-]+\\.[a-z]{2,}$') THEN 'domain' ELSE 'keyword' END AS kind FROM targets),
 compat AS (SELECT * FROM """ + duck.values([(k, t) for k, ts in V.TARGET_COMPAT.items() for t in ts], "kind, target_type") + """),
 checks AS (SELECT * FROM """ + duck.values([(i, c[0], c[3]) for i, c in enumerate(V.CHECKS) if not c[5] and c[0] not in V.CHECK_EXCLUDED_IDS],
                                            "position, check_id, target_type") + """),
 work AS (SELECT target, kind, check_id, position, CASE WHEN target_type = 'url' AND kind = 'domain' THEN 'https://' || target
    WHEN target_type = 'domain' AND kind = 'url' THEN lower(regexp_extract(target, '^https?://([^/:?#]+)', 1)) ELSE target END AS arg
   FROM kinds_t JOIN compat USING (kind) JOIN checks USING (target_type))"""


@query(f"{_H}, {_TARGETS} SELECT target, kind FROM kinds_t")
def target_kinds(spark, d):
    t = views.targets(spark, d)
    return t.select("target", registry.target_kind(F.col("target")).alias("kind"))


@query(f"{_H}, {_TARGETS} SELECT target, kind, check_id, position, arg FROM work")
def applicable_checks(spark, d):
    return registry.applicable(views.targets(spark, d))


def _of(name: str, check_id: str, target: str = "target") -> str:
    return f"SELECT '{check_id}' AS check_id, {target} AS target, severity FROM ({ORACLE[name]})"


_PAGE_CHECKS = (duck.union_rules("http_obs", "website", "url", _WEBSITE) + " UNION ALL "
                + duck.union_rules("(SELECT url, days FROM http_obs JOIN tls_obs USING (host) WHERE starts_with(final_url, 'https://'))", "website", "url", duck.EXPIRY))
_EVERY_CHECK = " UNION ALL ".join([
    f"SELECT check_id, target, severity FROM ({_PAGE_CHECKS})",
    _of("dns_posture", "dns"), _of("caa_records", "caa"), _of("tls_expiry", "tls"), _of("domain_age", "rdap"),
    _of("security_txt", "security-txt"), _of("typosquat_hits", "typosquat"), _of("breached_accounts", "breach"), _of("subdomains", "subdomains"),
    _of("cors_policy", "cors"), "SELECT check_id, target, severity FROM (" + duck.union_rules(
        _RD.replace("host || '#' || page_id AS host", "host").replace("FROM http_obs)", "FROM http_obs QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1)"),
        "https-redirect", "host", _REDIRECT) + ")",
    _of("cookie_flags", "cookies"), _of("mixed_content", "mixed-content"),
    _of("package_lookup", "package"),
    """SELECT 'cve', keyword, CASE WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' WHEN s IS NOT NULL THEN 'LOW' ELSE 'MEDIUM' END
       FROM (SELECT p_name || ' in ' || p_type AS text, coalesce(CASE WHEN p_partkey % 4 = 0 THEN p_size / 5.0::DOUBLE END,
         CASE WHEN p_partkey % 3 = 0 THEN p_size / 6.0::DOUBLE END, CASE WHEN p_partkey % 2 = 0 THEN p_size / 7.0::DOUBLE END) AS s FROM part)
       JOIN (SELECT DISTINCT p_name AS keyword FROM part) ON contains(lower(text), trim(lower(keyword)))"""])
_SEEN = " UNION ".join(
    [f"SELECT '{c}' AS check_id, url AS target FROM http_obs" for c in ("website", "cors")]
    + [f"SELECT '{c}', host FROM http_obs" for c in ("cookies", "mixed-content")]
    + [f"SELECT '{c}', host FROM hosts" for c in ("https-redirect", "security-txt", "dns", "caa")]
    + ["SELECT 'tls', host FROM tls_obs", "SELECT 'rdap', host FROM rd"])
_CARDS = f"""keyed AS (SELECT DISTINCT check_id, arg, CASE WHEN check_id IN ('security-txt', 'https-redirect', 'cookies', 'mixed-content')
     THEN lower(regexp_extract(arg, '^https?://([^/:?#]+)', 1)) WHEN check_id = 'typosquat' THEN regexp_replace(arg, '^www[.]', '') ELSE arg END AS target FROM work),
 found AS (SELECT check_id, arg, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
   count(*) FILTER (severity = 'LOW') AS low FROM ({_EVERY_CHECK}) JOIN keyed USING (check_id, target) GROUP BY ALL),
 failed AS (SELECT check_id, arg FROM keyed WHERE check_id NOT IN ('typosquat', 'breach', 'subdomains', 'package', 'cve') AND (check_id, target) NOT IN ({_SEEN})),
 cards AS (SELECT w.target, kind, w.check_id, position, w.arg, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW'
     WHEN e.arg IS NOT NULL THEN 'ERROR' ELSE 'CLEAN' END AS worst, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
   FROM work w LEFT JOIN found f ON f.check_id = w.check_id AND f.arg = w.arg LEFT JOIN failed e ON e.check_id = w.check_id AND e.arg = w.arg)"""
_CARDS_W = duck.with_(duck.HTTP, _RDAP, _TARGETS, _CARDS)


def _cards(spark, d) -> DataFrame:
    plain, secure = _plain_and_secure(spark, d, per_host=True)
    return registry.cards(views.targets(spark, d), registry.Observations(
        now=_now(), http=views.http_obs(spark, d), plain=plain, secure=secure, certificates=views.tls_obs(spark, d), dns=views.dns_obs(spark, d),
        rdap=views.rdap_obs(spark, d), security_txt=views.security_txt_obs(spark, d), certificate_log=views.ct_entries(spark, d),
        registered=views.registered_domains(spark, d), breaches=views.breaches(spark, d),
        advisories=advisories.parsed(views.advisory_documents(spark, d)), cves=views.cves(spark, d)))


@query(f"{_CARDS_W} SELECT * FROM cards")
def check_verdicts(spark, d):
    return _cards(spark, d)


@query(f"""{_CARDS_W} SELECT target, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low,
   {', '.join(f"count(*) FILTER (worst = '{v}') AS checks_{v.lower()}" for v in registry.VERDICTS)} FROM cards GROUP BY target""")
def target_verdicts(spark, d):
    return registry.target_totals(_cards(spark, d))


@query(r"""WITH a AS (SELECT 'host-' || doc_id AS host, unnest(list_concat(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'),
     [['10.1.2.3', '8.8.8.8', 'not-an-address', '172.32.0.1', '::1', '2606:4700::1111', '0:0:0:0:0:0:0:1', '0::1', '2001:0db8::1', '100::1', '64:ff9b:1::1', '0:0:0:0:0:ffff:10.0.0.1', '::ffff:8.8.8.8', '2002:a00:1::', 'fe80::1%eth0', '2001:4860:4860::8888', '2001:20::5', '2001:10::5', 'fd00::1', '3fff:1::1', 'ff02::1', '1:2:3', '2a00:1450:4001:81b::200e', '::'][doc_id % 24 + 1]])) AS ip FROM documents),
   o AS (SELECT host, ip, list_transform(string_split(ip, '.'), lambda x: try_cast(x AS BIGINT)) AS p FROM a),
   n AS (SELECT host, ip, CASE WHEN len(p) = 4 AND len(list_filter(p, lambda x: x IS NULL OR x > 255)) = 0 THEN p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] END AS v FROM o),
   f AS (SELECT host, CASE WHEN v IS NOT NULL THEN NOT (v BETWEEN 0 AND 16777215 OR v BETWEEN 167772160 AND 184549375 OR v BETWEEN 2130706432 AND 2147483647 OR v BETWEEN 2851995648 AND 2852061183
      OR v BETWEEN 2886729728 AND 2887778303 OR v BETWEEN 3221225472 AND 3221225479 OR v BETWEEN 3221225642 AND 3221225643 OR v BETWEEN 3221225984 AND 3221226239 OR v BETWEEN 3232235520 AND 3232301055
      OR v BETWEEN 3323068416 AND 3323199487 OR v BETWEEN 3325256704 AND 3325256959 OR v BETWEEN 3405803776 AND 3405804031 OR v >= 3758096384) ELSE coalesce((SELECT ok FROM (VALUES ('10.1.2.3', false), ('8.8.8.8', true), ('not-an-address', NULL), ('172.32.0.1', true), ('::1', false), ('2606:4700::1111', true), ('0:0:0:0:0:0:0:1', false), ('0::1', false), ('2001:0db8::1', false), ('100::1', false), ('64:ff9b:1::1', false), ('0:0:0:0:0:ffff:10.0.0.1', false), ('::ffff:8.8.8.8', false), ('2002:a00:1::', false), ('fe80::1%eth0', false), ('2001:4860:4860::8888', true), ('2001:20::5', true), ('2001:10::5', false), ('fd00::1', false), ('3fff:1::1', true), ('ff02::1', false), ('1:2:3', NULL), ('2a00:1450:4001:81b::200e', true), ('::', false)) known(a, ok) WHERE a = ip), true) END AS ok FROM n)
   SELECT host, bool_and(ok) AS is_public FROM f GROUP BY host""")
def public_address_hosts(spark, d):
    return views.resolved_hosts(spark, d).select("host", resolves_public(F.col("addresses")).alias("is_public"))
