import json

import pytest
from pyspark.sql import functions as F

from sentrymill.fixed_values import posture as V
from sentrymill.functions.network import hostname, is_public, resolves_public
from sentrymill.operators import checks
from sentrymill.plans import registry

def now():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def titles(df):
    return sorted((r.severity, r.title) for r in df.collect())


def test_addresses(spark):
    import ipaddress
    addresses = ["8.8.8.8", "10.0.0.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "192.0.2.1", "224.0.0.1", "255.255.255.255",
                 "0.0.0.0", "1.2.3.4", "198.18.0.1", "203.0.113.5", "::1", "::", "fe80::1", "fd00::1", "ff02::1", "2606:4700::1111", "2001:db8::1", "192.0.0.1"]
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    got = {r.a: r.p for r in df.select("a", is_public(F.col("a")).alias("p")).collect()}

    def public(a):
        x = ipaddress.ip_address(a)
        return not (x.is_private or x.is_loopback or x.is_link_local or x.is_reserved or x.is_multicast or x.is_unspecified)

    assert got == {a: public(a) for a in addresses}
    lists = spark.createDataFrame([(["8.8.8.8", "bad"],), (["bad"],), (["8.8.8.8", "10.0.0.1"],), (None,), (["300.1.1.1"],)], "l array<string>")
    assert [r.p for r in lists.select(resolves_public(F.col("l")).alias("p")).collect()] == [True, True, False, False, True]


def test_hostname(spark):
    cases = {"https://EXAMPLE.com:8443/x": "example.com", "Example.com.": "example.com", " /a.b/ ": "a.b", "http://": "http:"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.h for r in df.select("t", hostname(F.col("t")).alias("h")).collect()}
    assert {k: got[k] for k in list(cases)[:3]} == {k: cases[k] for k in list(cases)[:3]}


@pytest.mark.parametrize("hours, expected", [(-25, ("CRITICAL", "Expired 1 day(s) ago.")), (-23, ("HIGH", "0 day(s) left.")), (1, ("HIGH", "0 day(s) left.")),
                                              (15 * 24 - 1, ("HIGH", "14 day(s) left.")), (15 * 24, ("MEDIUM", "15 day(s) left.")), (30 * 24, None)])
def test_expiry_truncates(spark, hours, expected):
    df = spark.range(1).select(F.lit("h").alias("host"), F.lit(False).alias("tls10"), F.lit(None).cast("boolean").alias("tls11"),
                               F.timestamp_add("HOUR", F.lit(hours), now()).alias("not_after"), F.lit("CA").alias("issuer"))
    assert [(r.severity, r.detail) for r in checks.tls(df, now()).collect()] == ([expected] if expected else [])


def test_rdap_floors(spark):
    def run(registered, expires):
        df = spark.createDataFrame([("d", [("registration", "bad"), ("registration", registered), ("expiration", expires)], None)],
                                   "domain string, events array<struct<eventAction:string,eventDate:string>>, registrar string")
        return sorted(r.detail for r in checks.rdap(df, now()).collect())

    assert run("2024-01-15T13:00:00Z", "2024-01-16T11:00:00Z") == ["1 day(s) until expiry.", "Registered -1 day(s) ago — a common phishing indicator."]
    assert run("2020-01-01T00:00:00Z", "2024-02-14T12:00:00Z") == []
    assert run("2020-01-01T00:00:00Z", "2024-02-14T11:59:59Z") == []  # minus 30 days less a second floors to -30
    assert run("2020-01-01T00:00:00Z", "2024-02-13T12:00:00Z") == ["29 day(s) until expiry."]
    assert run("nonsense", None) == []


def test_registrar(spark):
    df = spark.createDataFrame([([(["abuse"], [("fn", "No")]), (["registrar"], [("version", "4"), ("fn", "Yes")])],)],
                               "e array<struct<roles:array<string>,vcard:array<struct<name:string,value:string>>>>")
    assert df.select(checks.registrar(F.col("e")).alias("r")).first().r == "Yes"


def test_website(spark):
    http = spark.createDataFrame([
        ("https://a.example/", "https://a.example/", {h.upper(): "x" for h, *_ in V.SECURITY_HEADERS}, ["s=1; Secure; HttpOnly"]),
        ("http://b.example/", "http://b.example/", {"Server": "nginx/1", "X-Powered-By": "p"}, ["s=1"])],
        "url string, final_url string, headers map<string,string>, cookies array<string>")
    certs = spark.range(1).select(F.lit("a.example").alias("host"), F.timestamp_add("DAY", F.lit(99), now()).alias("not_after"))
    found = checks.website(http, certs, now())
    assert titles(found.where("target like '%a.example%'")) == []
    assert {t for _, t in titles(found)} >= {"Site not served over HTTPS", "HSTS not set", "Server version disclosed", "Technology disclosed",
                                             "Cookie without Secure flag", "Cookie without HttpOnly flag"}
    assert {r.target: r.grade for r in checks.header_grades(http).collect()} == {"https://a.example/": "A", "http://b.example/": "F"}


def test_typo_variants(spark):
    def independent(name, tld):
        out = {name[:i] + name[i + 1:] + "." + tld for i in range(len(name))}
        out |= {name[:i] + name[i + 1] + name[i] + name[i + 2:] + "." + tld for i in range(len(name) - 1)}
        out |= {name[:i + 1] + name[i:] + "." + tld for i in range(len(name))}
        out |= {f"{name}.{t}" for t in V.TYPO_TLDS if t != tld}
        return sorted(v for v in out - {f"{name}.{tld}"} if not v.startswith("."))

    names = [("example", "com"), ("a", "xyz"), ("aa", "de"), ("my-shop.co", "uk")]
    df = spark.createDataFrame(names, "n string, t string")
    got = {(r.n, r.t): r.v for r in df.select("n", "t", checks.typo_variants(F.col("n"), F.col("t")).alias("v")).collect()}
    assert got == {k: independent(*k) for k in names}
    domains = spark.createDataFrame([("https://www.Example.com/x",), ("nodot",)], "domain string")
    registered = spark.createDataFrame([("exmple.com",), ("example.app",), ("zzz.com",)], "domain string")
    hits = {r.title.split(": ")[1] for r in checks.typosquat(domains, registered).collect()}
    assert hits == {"example.app", "exmple.com"}
    capped = {r.title.split(": ")[1] for r in checks.typosquat(domains, registered, cap=20).collect()}
    assert capped == hits & set(independent("example", "com")[:20])


def test_subdomains(spark):
    entries = spark.createDataFrame([("example.com", "*.A.example.com\nexample.com\nnotexample.com\r\n b.example.com "), ("example.com", "a.example.com")],
                                    "domain string, name_value string")
    assert [t for _, t in titles(checks.subdomains(entries))] == ["a.example.com", "b.example.com"]
    many = spark.range(250).selectExpr("'d.com' AS domain", "concat('s', lpad(id, 3, '0'), '.d.com') AS name_value")
    assert [t for _, t in titles(checks.subdomains(many))] == [f"s{i:03d}.d.com" for i in range(250)]
    assert [t for _, t in titles(checks.subdomains(many, cap=100))] == [f"s{i:03d}.d.com" for i in range(100)]
    assert checks.subdomain_totals(many).first().total == 250


def test_security_txt_order(spark):
    rows = [("a", "/security.txt", 200, "x"), ("a", "/.well-known/security.txt", 200, "CONTACT: y"), ("b", "/security.txt", 200, "x"),
            ("c", "/.well-known/security.txt", 404, "contact:"), ("d", "/.well-known/security.txt", 200, " " * 4000 + "contact:")]
    found = checks.security_txt(spark.createDataFrame(rows, "host string, path string, status int, body string"))
    assert {r.target: r.title.split()[0] for r in found.collect()} == {"b": "security.txt", "c": "No"}  # the whole body counts


def test_redirects_and_hsts(spark):
    plain = spark.createDataFrame([("a", 301, "https://a/", None), ("b", 302, None, None), ("c", 200, None, None), ("d", None, None, "down")],
                                  "host string, status int, location string, error string")
    secure = spark.createDataFrame([("a", "max-age=31536000; includeSubDomains; preload", None), ("b", "includesubdomains", None), ("c", None, None)],
                                   "host string, hsts string, error string")
    got = {h: {t for s, t in titles(checks.https_redirect(plain, secure).where(F.col("target") == h))} for h in "abcd"}
    assert got == {"a": set(), "b": {"HTTP redirects, but not to HTTPS", "HSTS max-age below preload threshold", "HSTS not preload-ready"},
                   "c": {"HTTP served directly (no HTTPS redirect)", "No HSTS header"},
                   "d": {"Could not reach site over HTTP", "Could not reach site over HTTPS"}}


def test_cookie_name_counts_as_flag(spark):
    http = spark.createDataFrame([("https://h/", ["__Secure-x=1; HttpOnly; SameSite=None", "a=1; SameSite=None"])], "url string, cookies array<string>")
    assert titles(checks.cookies(http)) == [("LOW", "Cookie 'a' missing HttpOnly"), ("MEDIUM", "Cookie 'a' SameSite=None without Secure"),
                                            ("MEDIUM", "Cookie 'a' missing Secure")]


def test_mixed_content(spark):
    body = "<a HREF = 'http://x/1'>" + '"http://cdn/a.JPEG"' + 'src="https://ok/"' + "".join(f'src="http://z/{i:02d}"' for i in range(30))
    df = spark.createDataFrame([("https://h/", 200, "x" * 600_000 + body, "https://h/"), ("https://g/", 404, body, "https://g/"), ("https://p/", 200, body, "http://p/")],
                               "url string, status int, body string, final_url string")
    urls = [r.detail.split(" ")[0] for r in checks.mixed_content(df).collect()]
    assert len(urls) == 32 and urls[0] == "http://cdn/a.JPEG" and "http://x/1" in urls  # whole body, HTTPS pages only
    assert checks.mixed_content(df, cap=15).count() == 15


def test_dns_and_caa(spark):
    rows = [("d", "TXT", ['"V=SPF1 +all"'], None), ("_dmarc.d", "TXT", ['"v=DMARC1; P=NONE"'], None), ("d", "A", ["x"], True), ("d", "MX", ["m"], None),
            ("d", "CAA", [" "], None), ("e", "A", ["x"], False), ("e", "CAA", ["0 issue"], None)]
    dns = spark.createDataFrame(rows, "domain string, rtype string, answers array<string>, ad boolean")
    assert titles(checks.dns_health(dns).where("target = 'd'")) == [("HIGH", "SPF allows all senders (+all)"), ("LOW", "DMARC policy is p=none")]
    assert {t for _, t in titles(checks.dns_health(dns).where("target = 'e'"))} == {"No SPF record", "No DMARC record", "DNSSEC not validated", "No MX records"}
    assert {r.target for r in checks.caa(dns).collect()} == {"d"}


def test_passwords_never_show(spark):
    corpus = spark.createDataFrame([("hunter2",)], "p string").select(F.upper(F.sha1("p")).alias("h")).selectExpr("left(h, 5) AS prefix", "substring(h, 6) AS suffix", "1234567L AS count")
    candidates = spark.createDataFrame([(1, "hunter2"), (2, "other")], "id bigint, password string")
    found = checks.pwned_password(candidates, corpus).collect()
    assert [(r.target, r.severity, r.detail) for r in found] == [("1", "HIGH", "Seen 1,234,567 time(s) — choose a different password.")]
    assert "hunter2" not in json.dumps([r.asDict() for r in found])


def test_target_kinds_and_work(spark):
    kinds = {"https://a.example/x": "url", "HTTP://A": "url", "flask@0.12.2": "package", "npm:left-pad@x": "package", "you@example.com": "email",
             "you@host": "keyword", "example.com": "domain", "openssl": "keyword", " Example.COM ": "domain"}
    df = spark.createDataFrame([(k,) for k in kinds], "target string")
    assert {r.target: r.k for r in df.select("target", registry.target_kind(F.col("target")).alias("k")).collect()} == kinds
    work = registry.applicable(df).where("target in ('example.com', 'https://a.example/x', 'openssl')").collect()
    by = {(w.target, w.check_id): w.arg for w in work}
    assert by[("example.com", "cors")] == "https://example.com" and by[("https://a.example/x", "dns")] == "a.example"
    assert ("openssl", "cve") in by and not [w for w in work if w.check_id in ("exposed-files", "open-redirect", "repo", "pwned-password")]


def test_verdicts(spark):
    work = spark.createDataFrame([("t", "domain", c, i, "t") for i, c in enumerate(["dns", "tls", "caa"])], "target string, kind string, check_id string, position int, arg string")
    found = spark.createDataFrame([("dns", "t", "LOW"), ("dns", "t", "HIGH")], "check_id string, arg string, severity string")
    errors = spark.createDataFrame([("dns", "t"), ("tls", "t")], "check_id string, arg string")
    cards = registry.verdicts(work, found, errors)
    ordered = [(c.check_id, c.worst) for c in cards.orderBy(registry.verdict_rank(F.col("worst")), "position").collect()]
    assert ordered == [("dns", "HIGH"), ("caa", "CLEAN"), ("tls", "ERROR")]
    total = registry.target_totals(cards).first()
    assert (total.high, total.low, total.checks_clean, total.checks_error) == (1, 1, 1, 1)


def test_registry_is_complete(spark):
    ids = [r.check_id for r in registry.list_checks(spark).orderBy("position").collect()]
    assert len(ids) == 19
    usable = {r.check_id for r in registry.applicable(spark.createDataFrame([("https://a.example/",), ("a.example",), ("a@b.example",), ("x@1.0",), ("word",)],
                                                                             "target string")).collect()}
    assert usable == set(registry.RUNS)  # every check that may be applied has a way to run


def test_public_addresses_agree_with_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(7)
    some = ["0:0:0:0:0:0:0:1", "0::1", "2001:0db8::1", "100::1", "64:ff9b:1::1", "64:ff9b::1", "0:0:0:0:0:ffff:10.0.0.1", "::ffff:8.8.8.8", "2002:a00:1::", "fe80::1",
            "2001:4860:4860::8888", "2001:1::1", "2001:1::3", "2001:20::5", "2001:3::", "2001:4:112::7", "3fff::1", "ff02::1", "::", "1::2::3", "1:2:3", ":::", "12345::",
            "::1.2.3.4", "2001:db8:0:0:0:0:0:0:1", "fc00::", "2000::", "4000::1", "1:2:3:4:5:6:7::", "::ffff:999.1.1.1"]
    some += [str(ipaddress.IPv6Address((0x2001 << 112 if rng.random() < 0.5 else 0) | rng.getrandbits(rng.choice([128, 112, 100, 40])) % (1 << 128))) for _ in range(300)]
    some += [ipaddress.IPv6Address(x).exploded.upper() for x in some[-20:]]

    def expected(text):
        try:
            x = ipaddress.ip_address(text)
        except ValueError:
            return None
        return not (x.is_private or x.is_loopback or x.is_link_local or x.is_reserved or x.is_multicast or x.is_unspecified)

    got = {r.a: r.p for r in spark.createDataFrame([(a,) for a in some + ["fe80::1%eth0"]], "a string").select("a", is_public(F.col("a")).alias("p")).collect()}
    assert {a: got[a] for a in some} == {a: expected(a) for a in some}
    assert got["fe80::1%eth0"] is False


def test_https_redirect_counts_a_host_once(spark):
    plain = spark.createDataFrame([("a", 200, None, None), ("a", 200, None, None), ("a", None, None, "timeout")], "host string, status int, location string, error string")
    secure = spark.createDataFrame([("a", "", None)] * 4, "host string, hsts string, error string")
    found = titles(checks.https_redirect(plain, secure))
    assert sorted(t for _, t in found) == ["HTTP served directly (no HTTPS redirect)", "No HSTS header"]


def test_public_addresses_are_parsed_once(spark):
    plan = spark.createDataFrame([("1.2.3.4",)], "a string").select(is_public(F.col("a")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") + plan.lower().count("rlike") < 30
