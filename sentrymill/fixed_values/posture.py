"""Values of the posture checks: headers, probe lists, thresholds, the check registry.

Fixed values: titles, details, lists and thresholds are part of the results.
"""

# --- fixed values -----------------------------------------------------------
# (header, severity, title, detail)
SECURITY_HEADERS = [
    ("strict-transport-security", "MEDIUM", "HSTS not set", "Add Strict-Transport-Security to enforce HTTPS."),
    ("content-security-policy", "MEDIUM", "No Content-Security-Policy", "A CSP mitigates XSS and data injection."),
    ("x-content-type-options", "LOW", "X-Content-Type-Options missing", "Set to 'nosniff' to stop MIME sniffing."),
    ("x-frame-options", "LOW", "X-Frame-Options missing", "Prevent clickjacking (or use CSP frame-ancestors)."),
    ("referrer-policy", "LOW", "Referrer-Policy missing", "Limit referrer leakage to other sites."),
    ("permissions-policy", "LOW", "Permissions-Policy missing",
     "Restrict browser features (camera, geolocation, ...)."),
]

SECURITY_TXT_PATHS = ["/.well-known/security.txt", "/security.txt"]

# (path, marker that must occur in the body; empty = any body)
EXPOSED_PATHS = [
    ("/.git/HEAD", "ref:"),
    ("/.env", "="),
    ("/.svn/entries", ""),
    ("/.DS_Store", ""),
    ("/.aws/credentials", "aws_"),
    ("/server-status", "Apache"),
    ("/backup.zip", ""),
]

REDIRECT_PARAMS = ["redirect", "redirect_uri", "redirect_url", "url", "next", "return", "returnUrl", "return_to",
                   "continue", "dest", "destination", "go", "target"]

TYPO_TLDS = ["com", "net", "org", "co", "io", "app", "dev", "xyz"]
HSTS_MIN_AGE = 15552000
PWNED_HIGH = 1000

MIXED_ATTRIBUTE = r"""(?i)(?:src|href)\s*=\s*['"]http://[^'"]+['"]"""
MIXED_ASSET = r"""(?i)['"]http://[^'"]+\.(?:js|css|png|jpe?g|gif|svg|woff2?|mp4|webp)['"]"""
MIXED_URL = r"""http://[^'"\s>]+"""

# (id, name, category, target_type, tier, requires_auth, description)
CHECKS = [
    ("repo", "Repository scan", "Repo", "repo", "free", False, "Secrets, vulnerable dependencies and insecure code."),
    ("website", "Website posture", "Web", "url", "free", False,
     "HTTPS, security headers, cookies, TLS expiry (passive)."),
    ("dns", "DNS & email auth", "Web", "domain", "free", False, "SPF, DMARC, DNSSEC and MX hygiene."),
    ("security-txt", "security.txt", "Web", "url", "free", False,
     "Checks for an RFC 9116 /.well-known/security.txt."),
    ("typosquat", "Typosquat domains", "Identity", "domain", "free", False,
     "Finds registered look-alike domains of your brand."),
    ("breach", "Email breach", "Identity", "email", "free", False,
     "Have I Been Pwned lookup (needs HIBP_API_KEY)."),
    ("pwned-password", "Pwned password", "Identity", "password", "free", False,
     "Check a password against the breach corpus (k-anonymity)."),
    ("subdomains", "Subdomain discovery", "Web", "domain", "free", False,
     "Find subdomains via Certificate Transparency logs (crt.sh)."),
    ("tls", "TLS/SSL deep check", "Web", "domain", "free", False,
     "Deprecated protocols (TLS 1.0/1.1) and certificate detail."),
    ("cors", "CORS misconfiguration", "Web", "url", "free", False,
     "Detects a reflected or wildcard cross-origin policy."),
    ("https-redirect", "HTTPS redirect & HSTS", "Web", "url", "free", False,
     "Checks HTTP→HTTPS redirect and HSTS strength/preload eligibility."),
    ("cookies", "Cookie flags", "Web", "url", "free", False,
     "Inspects Set-Cookie for Secure, HttpOnly and SameSite."),
    ("mixed-content", "Mixed content", "Web", "url", "free", False,
     "Finds insecure HTTP sub-resources loaded by an HTTPS page."),
    ("exposed-files", "Exposed files", "Web", "url", "free", True,
     "Probes for /.git, /.env, backups, etc. Authorized targets only."),
    ("open-redirect", "Open redirect", "Web", "url", "free", True,
     "Probes common redirect parameters for unvalidated external redirects. Authorized targets only."),
    ("rdap", "Domain info (RDAP)", "Domain", "domain", "free", False,
     "Registration date, registrar and expiry; flags new/expiring domains."),
    ("caa", "CAA records", "Domain", "domain", "free", False,
     "Which certificate authorities may issue for the domain."),
    ("package", "Package vulnerabilities", "Supply chain", "package", "free", False,
     "Look up name@version against OSV, e.g. flask@0.12.2."),
    ("cve", "CVE keyword search", "Intel", "keyword", "free", False,
     "Search NVD for recent CVEs matching a product or term."),
]
CHECK_EXCLUDED_IDS = ["repo", "password"]
# kind of entered target -> target types of the checks that fit it
TARGET_COMPAT = {
    "url": ["url", "domain"],
    "domain": ["domain", "url"],
    "email": ["email"],
    "package": ["package"],
    "keyword": ["keyword"],
}
# --- end of fixed values ----------------------------------------------------
