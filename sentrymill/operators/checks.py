"""Posture checks as rules over observation tables.

Each check takes what a crawler, resolver or log saw for *all* targets and
returns (check_id, target, severity, title, detail).  Within one observation
row all rules are one array expression; rows move only where a check combines
several observations of a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrymill.fixed_values import posture as V
from sentrymill.functions.network import host_of_url, hostname
from sentrymill.functions.text import strip
from sentrymill.functions.versions import remediation
from sentrymill.session import literal_table, spread_join

PROBE_ORIGIN = "https://cors-probe.example"
PROBE_HOST = "redirect-probe.example"


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def finding(condition: Column, severity: str | Column, title: str | Column, detail: str | Column) -> Column:
    return F.when(condition, F.struct(_text(severity).alias("severity"), _text(title).alias("title"),
                                      _text(detail).alias("detail")))


def rows(df: DataFrame, check_id: str, target: str, findings: list[Column]) -> DataFrame:
    """One row per rule that holds, in rule order per observation."""
    return df.select(F.lit(check_id).alias("check_id"), F.col(target).alias("target"),
                     F.inline(F.array_compact(F.array(*findings))))


def _lower_keys(headers: Column) -> Column:
    return F.transform_keys(headers, lambda k, _: F.lower(k))


def _days_left(not_after: Column, now: Column) -> Column:
    """Whole days, truncated toward zero."""
    seconds = F.unix_micros(not_after.cast("timestamp")) - F.unix_micros(now)
    return (seconds / 86400e6).cast("int")


def _expiry(days: Column) -> list[Column]:
    left = F.format_string("%s day(s) left.", days.cast("string"))
    return [finding(days < 0, "CRITICAL", "TLS certificate expired",
                    F.format_string("Expired %s day(s) ago.", F.abs(days).cast("string"))),
            finding((days >= 0) & (days < 15), "HIGH", "TLS certificate expiring soon", left),
            finding((days >= 15) & (days < 30), "MEDIUM", "TLS certificate expiring soon", left)]


def website(http: DataFrame, certificates: DataFrame, now: Column, target: str = "final_url") -> DataFrame:
    """``http``: (url, final_url, headers, cookies); ``certificates``: (host, not_after), one per host.

    ``target`` names the column that is reported: where the request ended, or the ``url`` it began with.
    """
    secure = F.startswith("final_url", F.lit("https://"))
    seen = http.select("url", "final_url", "cookies", _lower_keys(F.col("headers")).alias("h"),
                       F.when(secure, host_of_url(F.col("url"))).alias("host"))
    joined = spread_join(seen, certificates.select("host", "not_after"), ["host"], "left")
    h = F.col("h")
    rules = [finding(~secure, "HIGH", "Site not served over HTTPS",
                     "Traffic is unencrypted — enable TLS and redirect HTTP to HTTPS.")]
    rules += [finding(~F.map_contains_key(h, name), severity, title, detail)
              for name, severity, title, detail in V.SECURITY_HEADERS]
    rules += [
        finding(F.try_element_at(h, F.lit("server")).rlike(r"\d"), "LOW", "Server version disclosed",
                F.concat(F.lit("Server: "), F.try_element_at(h, F.lit("server")))),
        finding(F.map_contains_key(h, "x-powered-by"), "LOW", "Technology disclosed",
                F.concat(F.lit("X-Powered-By: "), F.try_element_at(h, F.lit("x-powered-by")))),
        finding(F.exists("cookies", lambda c: ~F.contains(F.lower(c), F.lit("secure"))), "MEDIUM",
                "Cookie without Secure flag", "A cookie may be sent over plain HTTP."),
        finding(F.exists("cookies", lambda c: ~F.contains(F.lower(c), F.lit("httponly"))), "LOW",
                "Cookie without HttpOnly flag", "A cookie is readable by JavaScript (XSS risk).")]
    rules += _expiry(_days_left(F.col("not_after"), now))
    return rows(joined, "website", target, rules)


def header_grades(http: DataFrame) -> DataFrame:
    """(target, present, grade, summary) of the security headers."""
    h = _lower_keys(F.col("headers"))
    names = F.array(*[F.lit(n) for n, *_ in V.SECURITY_HEADERS])
    counted = http.select(F.col("final_url").alias("target"),
                          F.size(F.array_intersect(F.map_keys(h), names)).alias("present"))
    n = F.col("present")
    grade = F.when(n >= 6, "A").when(n >= 5, "B").when(n >= 4, "C").when(n >= 2, "D").otherwise("F")
    scheme = F.when(F.startswith("target", F.lit("https")), "HTTPS").otherwise("no HTTPS")
    return counted.select("target", "present", grade.alias("grade"), F.format_string(
        "Security header grade: %s (%s/6 headers, %s)", grade, n.cast("string"), scheme).alias("summary"))


def dns_health(dns: DataFrame) -> DataFrame:
    """``dns``: (domain, rtype, answers, ad); the DMARC record is the TXT answer of ``_dmarc.<domain>``."""
    dmarc_row = (F.col("rtype") == "TXT") & F.startswith("domain", F.lit("_dmarc."))
    owner = F.when(dmarc_row, F.substring("domain", 8, 2147483647)).otherwise(F.col("domain"))
    texts = F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a, F.lit('"'))))
    seen = dns.select(owner.alias("domain"), "rtype", dmarc_row.alias("dmarc"), texts.alias("t"), "ad")

    def any_text(condition: Column, test) -> Column:
        return F.coalesce(F.bool_or(condition & F.exists("t", test)), F.lit(False))

    spf_row = (F.col("rtype") == "TXT") & ~F.col("dmarc")
    spf = lambda t: F.startswith(t, F.lit("v=spf1"))
    policy = lambda t: F.contains(t, F.lit("v=dmarc1"))
    facts = seen.groupBy("domain").agg(
        any_text(spf_row, spf).alias("spf"),
        any_text(spf_row, lambda t: spf(t) & F.contains(t, F.lit("+all"))).alias("open_spf"),
        any_text(F.col("dmarc"), policy).alias("has_dmarc"),
        any_text(F.col("dmarc"), lambda t: policy(t) & F.contains(t, F.lit("p=none"))).alias("dmarc_none"),
        F.coalesce(F.bool_or((F.col("rtype") == "A") & F.col("ad")), F.lit(False)).alias("dnssec"),
        F.coalesce(F.bool_or((F.col("rtype") == "MX") & (F.size("t") > 0)), F.lit(False)).alias("mx"))
    return rows(facts, "dns", "domain", [
        finding(~F.col("spf"), "MEDIUM", "No SPF record", "Add an SPF TXT record to curb email spoofing."),
        finding(F.col("open_spf"), "HIGH", "SPF allows all senders (+all)", "Tighten the policy to ~all or -all."),
        finding(~F.col("has_dmarc"), "MEDIUM", "No DMARC record", "Add a _dmarc TXT record (start at p=none)."),
        finding(F.col("dmarc_none"), "LOW", "DMARC policy is p=none", "Move to p=quarantine or p=reject when ready."),
        finding(~F.col("dnssec"), "LOW", "DNSSEC not validated", "Responses are not DNSSEC-signed/validated."),
        finding(~F.col("mx"), "LOW", "No MX records", "No mail servers configured for this domain.")])


def security_txt(probes: DataFrame) -> DataFrame:
    """``probes``: (host, path, status, body).  The first listed path with status 200 decides."""
    place = F.array_position(F.array(*[F.lit(p) for p in V.SECURITY_TXT_PATHS]), F.col("path"))
    contact = F.contains(F.lower("body"), F.lit("contact:"))
    answer = F.when((F.col("status") == 200) & (place > 0), F.struct(place.alias("place"), contact.alias("contact")))
    first = probes.groupBy("host").agg(F.min(answer).alias("a"))
    return rows(first, "security-txt", "host", [
        finding(F.col("a").isNull(), "LOW", "No security.txt (RFC 9116)",
                "Add /.well-known/security.txt so researchers can reach you."),
        finding(F.col("a").isNotNull() & ~F.coalesce("a.contact", F.lit(False)), "LOW",
                "security.txt present but missing Contact field", "RFC 9116 requires a Contact field.")])


def typo_variants(name: Column, tld: Column) -> Column:
    """Sorted look-alikes: a character left out, two swapped, one doubled, another top-level domain."""
    def cut(start, length) -> Column:
        return F.substr(name, start, length)

    n, far = F.length(name), F.lit(2147483647)
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    pairs = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    one, two = F.lit(1), F.lit(2)
    omitted = F.transform(every, lambda i: F.concat(cut(one, i - 1), cut(i + 1, far)))
    swapped = F.transform(pairs, lambda i: F.concat(cut(one, i - 1), cut(i + 1, one), cut(i, one), cut(i + two, far)))
    doubled = F.transform(every, lambda i: F.concat(cut(one, i), cut(i, one), cut(i + 1, far)))
    same_tld = F.transform(F.concat(omitted, swapped, doubled), lambda v: F.concat(v, F.lit("."), tld))
    others = F.transform(F.filter(F.array(*[F.lit(t) for t in V.TYPO_TLDS]), lambda t: t != tld),
                         lambda t: F.concat(name, F.lit("."), t))
    own = F.concat(name, F.lit("."), tld)
    return F.array_sort(F.array_distinct(F.filter(F.concat(same_tld, others),
                                                  lambda v: (v != own) & ~F.startswith(v, F.lit(".")))))


def typosquat(domains: DataFrame, registered: DataFrame, cap: int | None = None) -> DataFrame:
    """Look-alikes of each ``domain`` found in ``registered``; a caller may have only the first ``cap`` variants looked up."""
    bare = F.regexp_replace(hostname(F.col("domain")), r"\Awww\.", "")
    named = domains.select(bare.alias("domain")).where(F.contains("domain", F.lit("."))).distinct()
    variants = typo_variants(F.regexp_extract("domain", r"\A(.*)\.([^.]*)\z", 1), F.substring_index("domain", ".", -1))
    looked_up = F.slice(variants, 1, cap) if cap else variants
    each = named.select("domain", F.explode(looked_up).alias("variant"))
    hits = spread_join(each, registered.select(F.col("domain").alias("variant")).distinct(), ["variant"], "left_semi")
    return hits.select(
        F.lit("typosquat").alias("check_id"), F.col("domain").alias("target"), F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("Look-alike domain registered: "), F.col("variant")).alias("title"),
        F.lit("A typosquat of your domain is registered — possible phishing vector.").alias("detail"))


def breach(emails: DataFrame, breaches: DataFrame) -> DataFrame:
    """``breaches``: (email, title, breach_date, data_classes); one finding per breach of an ``email``."""
    classes = F.coalesce("data_classes", F.array().cast("array<string>"))
    wanted = spread_join(breaches, emails.select("email").distinct(), ["email"], "left_semi")
    return wanted.select(
        F.lit("breach").alias("check_id"), F.col("email").alias("target"),
        F.when(F.array_contains(classes, "Passwords"), "HIGH").otherwise("MEDIUM").alias("severity"),
        F.concat(F.lit("Found in breach: "), F.col("title"), F.lit(" ("),
                 F.coalesce(F.date_format("breach_date", "yyyy-MM-dd"), F.lit("?")), F.lit(")")).alias("title"),
        F.when(F.size(classes) > 0, F.concat(F.lit("Exposed data: "), F.array_join(classes, ", "))).otherwise("")
        .alias("detail"))


def pwned_password(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """``candidates``: (id, password); ``corpus``: (prefix, suffix, count).  The password is hashed and dropped at once."""
    digest = F.upper(F.sha1("password"))
    hashed = candidates.select("id", F.left(digest, F.lit(5)).alias("prefix"),
                               F.substring(digest, 6, 35).alias("suffix"))
    found = spread_join(hashed, corpus, ["prefix", "suffix"]).where(F.col("count") > 0)
    return found.select(
        F.lit("pwned-password").alias("check_id"), F.col("id").cast("string").alias("target"),
        F.when(F.col("count") >= V.PWNED_HIGH, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.lit("Password found in known breaches").alias("title"),
        F.concat(F.lit("Seen "), F.format_number("count", 0), F.lit(" time(s) — choose a different password."))
        .alias("detail"))


def subdomain_names(entries: DataFrame) -> DataFrame:
    """Distinct (domain, name) below each domain from certificate-log entries (domain, name_value)."""
    domain = hostname(F.col("domain"))
    names = entries.select(domain.alias("domain"), F.explode(F.split("name_value", r"\r\n|[\n\r]")).alias("raw"))
    clean = F.ltrim(F.lower(strip(F.col("raw"))), F.lit("*."))
    return (names.select("domain", clean.alias("name"))
            .where(F.endswith("name", F.concat(F.lit("."), F.col("domain")))).distinct())


def subdomains(entries: DataFrame, cap: int | None = None) -> DataFrame:
    """All names per domain; a caller may ask for the first ``cap`` (the rank filters before the shuffle)."""
    shown = subdomain_names(entries)
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("domain").orderBy("name"))
        shown = shown.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return shown.select(F.lit("subdomains").alias("check_id"), F.col("domain").alias("target"),
                        F.lit("LOW").alias("severity"), F.col("name").alias("title"),
                        F.lit("Subdomain found in certificate transparency logs.").alias("detail"))


def subdomain_totals(entries: DataFrame) -> DataFrame:
    totals = subdomain_names(entries).groupBy(F.col("domain").alias("target")).agg(F.count("*").alias("total"))
    return totals.withColumn("summary", F.format_string("Found %s unique subdomain(s) in CT logs.",
                                                        F.col("total").cast("string")))


def tls(observed: DataFrame, now: Column) -> DataFrame:
    """``observed``: (host, tls10, tls11, not_after, issuer)."""
    old = [finding(F.coalesce(c, F.lit(False)), s, f"{label} is supported (deprecated)",
                   f"Disable {label}; serve TLS 1.2+ only.")
           for label, c, s in (("TLS 1.0", "tls10", "HIGH"), ("TLS 1.1", "tls11", "MEDIUM"))]
    return rows(observed, "tls", "host", old + _expiry(_days_left(F.col("not_after"), now)))


def tls_summary(observed: DataFrame, now: Column) -> DataFrame:
    days = _days_left(F.col("not_after"), now)
    return observed.select(F.col("host").alias("target"), F.format_string(
        "Issuer: %s; certificate valid for %s more day(s).", F.coalesce("issuer", F.lit("?")), days.cast("string"))
        .alias("summary"))


def cors(http: DataFrame, probe_origin: str = PROBE_ORIGIN) -> DataFrame:
    """``http``: responses (url, headers) to requests that carried ``probe_origin``."""
    h = _lower_keys(F.col("headers"))
    seen = http.select("url", F.try_element_at(h, F.lit("access-control-allow-origin")).alias("origin"),
                       (F.lower(F.coalesce(F.try_element_at(h, F.lit("access-control-allow-credentials")), F.lit("")))
                        == "true").alias("credentials"))
    echoed = F.col("origin") == probe_origin
    return rows(seen, "cors", "url", [
        finding(echoed & F.col("credentials"), "HIGH", "CORS reflects any origin with credentials",
                "Access-Control-Allow-Origin echoes the request Origin AND allows credentials — any site can read "
                "authenticated responses."),
        finding(echoed & ~F.col("credentials"), "MEDIUM", "CORS reflects any origin",
                "Access-Control-Allow-Origin echoes the request Origin — restrict it to known domains."),
        finding(F.col("origin") == "*", "LOW", "CORS allows all origins (*)",
                "Fine for public data, risky for anything authenticated.")])


def https_redirect(plain: DataFrame, secure: DataFrame) -> DataFrame:
    """``plain``: (host, status, location, error) of http://host/; ``secure``: (host, hsts, error) of https://host/.

    Several observations of a host and side count as one: one that was answered, of these that of the least values.
    """
    def one(side: DataFrame, name: str, *fields: str) -> DataFrame:
        found = F.struct(F.col("error").isNotNull().alias("failed"), *fields, "error")
        return side.groupBy("host").agg(F.min(found).alias(name))

    both = one(plain, "p", "status", "location").join(one(secure, "s", "hsts"), "host", "full")
    location, hsts = F.coalesce("p.location", F.lit("")), F.coalesce("s.hsts", F.lit(""))
    answered = F.col("p").isNotNull() & F.col("p.error").isNull()
    age = F.coalesce(F.regexp_extract(hsts, r"(?i)max-age\s*=\s*(\d+)", 1).try_cast("decimal(38,0)"),
                     F.lit(0).cast("decimal(38,0)"))
    low = F.lower(hsts)
    reached = F.col("s").isNotNull() & F.col("s.error").isNull()
    strong = reached & (hsts != "")
    return rows(both, "https-redirect", "host", [
        finding(answered & F.col("p.status").between(300, 399) & ~F.startswith(location, F.lit("https://")), "MEDIUM",
                "HTTP redirects, but not to HTTPS",
                F.concat(F.lit("HTTP responded "), F.col("p.status").cast("string"), F.lit(" to "),
                         F.when(location == "", "(no Location)").otherwise(location), F.lit("."))),
        finding(answered & (F.col("p.status") == 200), "HIGH", "HTTP served directly (no HTTPS redirect)",
                "Plain HTTP returns content instead of redirecting to HTTPS."),
        finding(~answered, "LOW", "Could not reach site over HTTP", F.coalesce("p.error", F.lit("no observation"))),
        finding(reached & (hsts == ""), "MEDIUM", "No HSTS header",
                "Add Strict-Transport-Security to force HTTPS on future visits."),
        finding(strong & (age < V.HSTS_MIN_AGE), "LOW", "HSTS max-age below preload threshold",
                F.concat(F.lit("max-age="), age.cast("string"),
                         F.lit(f"; use ≥{V.HSTS_MIN_AGE} (180d) for HSTS preload eligibility."))),
        finding(strong & ~F.contains(low, F.lit("includesubdomains")), "LOW", "HSTS missing includeSubDomains",
                "Add includeSubDomains so subdomains are also protected."),
        finding(strong & ~F.contains(low, F.lit("preload")), "LOW", "HSTS not preload-ready",
                "Add the preload directive and submit to hstspreload.org."),
        finding(~reached, "LOW", "Could not reach site over HTTPS", F.coalesce("s.error", F.lit("no observation")))])


def cookies(http: DataFrame) -> DataFrame:
    """Flags are substring tests over the whole cookie, its name included."""
    each = http.select(host_of_url(F.col("url")).alias("host"), F.explode("cookies").alias("c"))
    name = F.trim(F.substring_index("c", "=", 1))
    low = F.lower("c")
    secure, site = F.contains(low, F.lit("secure")), F.contains(low, F.lit("samesite"))

    def title(text: str) -> Column:
        return F.concat(F.lit("Cookie '"), name, F.lit("' " + text))

    return rows(each, "cookies", "host", [
        finding(~secure, "MEDIUM", title("missing Secure"), "May be transmitted over plain HTTP."),
        finding(~F.contains(low, F.lit("httponly")), "LOW", title("missing HttpOnly"),
                "Readable by JavaScript — XSS can steal it."),
        finding(~site, "LOW", title("missing SameSite"), "Set SameSite=Lax or Strict to mitigate CSRF."),
        finding(site & F.contains(low, F.lit("samesite=none")) & ~secure, "MEDIUM",
                title("SameSite=None without Secure"), "SameSite=None requires the Secure attribute.")])


def mixed_content(http: DataFrame, cap: int | None = None) -> DataFrame:
    """http:// resources of HTTPS pages answered with 200: distinct, sorted; a caller may ask for the first ``cap`` per page."""
    body = F.col("body")
    quoted = F.array_union(F.regexp_extract_all(body, F.lit(V.MIXED_ATTRIBUTE), F.lit(0)),
                           F.regexp_extract_all(body, F.lit(V.MIXED_ASSET), F.lit(0)))
    urls = F.flatten(F.transform(quoted, lambda x: F.regexp_extract_all(x, F.lit(V.MIXED_URL), F.lit(0))))
    shown = F.array_sort(F.array_distinct(urls))
    if cap is not None:
        shown = F.slice(shown, 1, cap)
    secure = http.where((F.col("status") == 200) & F.startswith(F.lower("final_url"), F.lit("https://")))
    each = secure.select(host_of_url(F.col("url")).alias("host"), F.explode(shown).alias("u"))
    return each.select(
        F.lit("mixed-content").alias("check_id"), F.col("host").alias("target"), F.lit("MEDIUM").alias("severity"),
        F.lit("Insecure (HTTP) resource on HTTPS page").alias("title"),
        F.concat(F.col("u"), F.lit(" — browsers may block it or warn; load it over HTTPS.")).alias("detail"))


def exposed_files(probes: DataFrame) -> DataFrame:
    """``probes``: (base, path, status, body)."""
    table = literal_table(probes.sparkSession, ["path", "marker"], V.EXPOSED_PATHS)
    body = F.lower("body")
    hit = probes.where(F.col("status") == 200).join(F.broadcast(table), "path").where(
        F.contains(body, F.lower("marker")))
    return hit.select(F.lit("exposed-files").alias("check_id"), F.col("base").alias("target"),
                      F.lit("HIGH").alias("severity"), F.concat(F.lit("Exposed: "), F.col("path")).alias("title"),
                      F.lit("Publicly accessible — block or remove it.").alias("detail"))


def open_redirect(probes: DataFrame, probe_host: str = PROBE_HOST) -> DataFrame:
    """``probes``: (url, param, payload, status, location); one finding per (url, param)."""
    hit = probes.where(F.col("status").between(300, 399) & F.contains(F.coalesce("location", F.lit("")), F.lit(probe_host))
                       & F.col("param").isin(V.REDIRECT_PARAMS))
    first = hit.groupBy("url", "param").agg(F.min(F.struct("payload", "status")).alias("p"))
    return first.select(
        F.lit("open-redirect").alias("check_id"), F.col("url").alias("target"), F.lit("MEDIUM").alias("severity"),
        F.format_string("Open redirect via '%s' parameter", "param").alias("title"),
        F.format_string("Request with ?%s=<external URL> returned a %s redirect to an attacker-controlled host. "
                        "Validate redirect targets against an allowlist.", F.col("param"),
                        F.col("p.status").cast("string")).alias("detail"))


def _event(action: str) -> Column:
    """Date of the last event with this action."""
    return F.try_element_at(F.filter("events", lambda e: e["eventAction"] == action), F.lit(-1))["eventDate"]


def _days_since(iso: Column, now: Column) -> Column:
    """Whole days, rounded down; null for an unreadable date."""
    micros = F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(iso))
    return F.floor(micros / 86400e6).cast("int")


def rdap(observed: DataFrame, now: Column) -> DataFrame:
    """``observed``: (domain, events, registrar)."""
    dated = observed.select("domain", _days_since(_event("registration"), now).alias("age"),
                            _days_since(_event("expiration"), now).alias("past"))
    return rows(dated, "rdap", "domain", [
        finding(F.col("age") < 90, "MEDIUM", "Recently registered domain", F.concat(
            F.lit("Registered "), F.col("age").cast("string"), F.lit(" day(s) ago — a common phishing indicator."))),
        finding(F.col("past") > -30, "MEDIUM", "Domain expiring soon",
                F.concat((-F.col("past")).cast("string"), F.lit(" day(s) until expiry.")))])


def rdap_summary(observed: DataFrame) -> DataFrame:
    unknown = F.lit("?")
    return observed.select(F.col("domain").alias("target"), F.format_string(
        "Registered %s, expires %s, registrar %s.", F.coalesce(_event("registration"), unknown),
        F.coalesce(_event("expiration"), unknown), F.coalesce("registrar", unknown)).alias("summary"))


def registrar(entities: Column) -> Column:
    """The full name in the vCard of the last entity acting as registrar.

    ``entities``: array<struct<roles array<string>, vcard array<struct<name, value>>>>.
    """
    acting = F.filter(entities, lambda e: F.array_contains(e["roles"], "registrar"))
    names = F.flatten(F.transform(acting, lambda e: F.filter(e["vcard"], lambda v: v["name"] == "fn")))
    return F.try_element_at(names, F.lit(-1))["value"]


def _caa(dns: DataFrame) -> DataFrame:
    kept = F.filter(F.transform("answers", lambda a: strip(a)), lambda a: a != "")
    own = dns.where(~F.startswith("domain", F.lit("_dmarc.")))
    return own.groupBy("domain").agg(F.max(F.when(F.col("rtype") == "CAA", kept)).alias("issuers"))


def caa(dns: DataFrame) -> DataFrame:
    return rows(_caa(dns), "caa", "domain", [
        finding(F.coalesce(F.size("issuers"), F.lit(0)) <= 0, "LOW", "No CAA record",
                "Without CAA, any certificate authority can issue certs for this domain. "
                "Add a CAA record to restrict it.")])


def caa_summary(dns: DataFrame) -> DataFrame:
    listed = F.concat(F.size("issuers").cast("string"), F.lit(" CAA record(s): "),
                      F.array_join("issuers", "; "))
    return _caa(dns).select(F.col("domain").alias("target"),
                            F.when(F.size("issuers") > 0, listed).otherwise("No CAA records found.").alias("summary"))


def repo_rows(findings: DataFrame) -> DataFrame:
    """Secrets, dependencies and code findings as check rows."""
    place = F.concat_ws(":", "file", F.col("line_no").cast("string"))
    phase = F.col("phase")
    title = (F.when(phase == "secrets", F.concat(F.lit("Secret: "), F.col("issue_type")))
             .when(phase == "deps", F.concat(F.lit("Vulnerable dependency: "), F.col("package"), F.lit("@"), F.col("version")))
             .otherwise(F.concat(F.lit("Insecure code: "), F.col("issue_type"))))
    fix = remediation(F.col("ecosystem"), F.col("package"), F.col("fixed_version"))
    detail = (F.when(phase == "secrets", F.concat(place, F.lit(" ("), F.col("matched_value"), F.lit(")")))
              .when(phase == "deps", F.concat_ws(" · ", "vuln_id", fix)).otherwise(place))
    return findings.where(phase.isin("secrets", "deps", "code")).select(
        F.lit("repo").alias("check_id"), "target", "severity", title.alias("title"), detail.alias("detail"))
