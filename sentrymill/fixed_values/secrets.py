"""Secret rules: our own selection of publicly documented token formats.

(name, category, severity, pattern, capture group of the value, needs).
Patterns avoid look-around so that other engines can run them unchanged.
"""

SECRET_RULES = [
    ("Private Key Block", "private_key", "CRITICAL",
     r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0, ("PRIVATE KEY",)),
    ("AWS Access Key ID", "cloud", "CRITICAL", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0, ("AKIA", "ASIA")),
    ("AWS Secret Access Key", "cloud", "CRITICAL",
     r"(?i)aws_?secret_?(?:access_?)?key['\"]?\s*[:=]\s*['\"]([A-Za-z0-9/+=]{40})['\"]", 1, ("aws",)),
    ("Google API Key", "cloud", "HIGH", r"\bAIza[0-9A-Za-z_-]{35}", 0, ("AIza",)),
    ("Google OAuth Access Token", "cloud", "HIGH", r"\bya29\.[0-9A-Za-z_-]{20,}", 0, ("ya29.",)),
    ("Azure Storage Account Key", "cloud", "CRITICAL", r"AccountKey=([A-Za-z0-9+/]{86}==)", 1, ("AccountKey=",)),
    ("DigitalOcean Token", "cloud", "HIGH", r"\bdo[opr]_v1_[a-f0-9]{64}\b", 0, ("_v1_",)),
    ("Heroku API Key", "cloud", "HIGH",
     r"(?i)heroku[a-z_ -]*['\"]?\s*[:=]\s*['\"]([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})['\"]",
     1, ("heroku",)),
    ("GitHub Token", "vcs", "CRITICAL", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b", 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("GitHub Fine-Grained Token", "vcs", "CRITICAL", r"\bgithub_pat_[A-Za-z0-9_]{36,255}\b", 0, ("github_pat_",)),
    ("GitLab Token", "vcs", "CRITICAL", r"\bglpat-[A-Za-z0-9_-]{20,}", 0, ("glpat-",)),
    ("Bitbucket App Password", "vcs", "HIGH", r"\bATBB[A-Za-z0-9]{32}\b", 0, ("ATBB",)),
    ("Stripe Live Secret Key", "payment", "CRITICAL", r"\b[sr]k_live_[0-9A-Za-z]{16,}\b", 0, ("k_live_",)),
    ("Stripe Test Secret Key", "payment", "LOW", r"\b[sr]k_test_[0-9A-Za-z]{16,}\b", 0, ("k_test_",)),
    ("Square Access Token", "payment", "CRITICAL", r"\bsq0atp-[0-9A-Za-z_-]{22}", 0, ("sq0atp-",)),
    ("Square OAuth Secret", "payment", "CRITICAL", r"\bsq0csp-[0-9A-Za-z_-]{43}", 0, ("sq0csp-",)),
    ("Braintree Access Token", "payment", "CRITICAL",
     r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}", 0, ("$production$",)),
    ("Slack Token", "communication", "HIGH", r"\bxox[abprs]-[0-9A-Za-z-]{10,}", 0, ("xox",)),
    ("Slack Webhook", "communication", "HIGH",
     r"https://hooks\.slack\.com/services/[A-Za-z0-9_/]{20,}", 0, ("hooks.slack.com",)),
    ("Discord Webhook", "communication", "HIGH",
     r"https://(?:discord|discordapp)\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+", 0, ("/api/webhooks/",)),
    ("Twilio API Key", "communication", "HIGH", r"\bSK[0-9a-f]{32}\b", 0, ("SK",)),
    ("SendGrid API Key", "communication", "HIGH",
     r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, ("SG.",)),
    ("Mailgun API Key", "communication", "HIGH", r"\bkey-[0-9a-f]{32}\b", 0, ("key-",)),
    ("Mailchimp API Key", "communication", "HIGH", r"\b[0-9a-f]{32}-us[0-9]{1,2}\b", 0, ("-us",)),
    ("Telegram Bot Token", "communication", "HIGH", r"\b[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", 0, (":AA",)),
    ("Database Connection String", "database", "CRITICAL",
     r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@'\"]+:[^\s/@'\"]+@[^\s'\"]+", 0,
     ("://",)),
    ("JSON Web Token", "token", "HIGH",
     r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, ("eyJ",)),
    ("Bearer Token", "token", "MEDIUM",
     r"(?i)authorization['\"]?\s*[:=]\s*['\"]?bearer\s+([A-Za-z0-9._~+/-]{20,})", 1, ("bearer",)),
    ("Basic Auth in URL", "credential", "HIGH",
     r"(?i)\bhttps?://[^\s:/@'\"]+:([^\s:/@'\"]{3,})@[^\s'\"]+", 1, ("://",)),
    ("Hardcoded Password", "credential", "HIGH",
     r"(?i)\b(?:password|passwd|pwd)['\"]?\s*[:=]\s*['\"]([^'\"\s]{8,})['\"]", 1, ("word", "wd")),
    ("Hardcoded API Key", "credential", "MEDIUM",
     r"(?i)\b(?:api|app|auth)[_-]?key['\"]?\s*[:=]\s*['\"]([A-Za-z0-9_-]{16,})['\"]", 1, ("key",)),
    ("Hardcoded Secret", "credential", "MEDIUM",
     r"(?i)\b(?:client_?)?secret(?:_?key)?['\"]?\s*[:=]\s*['\"]([^'\"\s]{8,})['\"]", 1, ("ecret",)),
    ("Hardcoded Token", "credential", "MEDIUM",
     r"(?i)\b(?:access_?|auth_?)?token['\"]?\s*[:=]\s*['\"]([A-Za-z0-9._-]{20,})['\"]", 1, ("token",)),
    ("OpenAI API Key", "ai", "CRITICAL", r"\bsk-(?:proj-)?[A-Za-z0-9_]{32,}", 0, ("sk-",)),
    ("Hugging Face Token", "ai", "HIGH", r"\bhf_[A-Za-z0-9]{34,}\b", 0, ("hf_",)),
    ("Replicate Token", "ai", "HIGH", r"\br8_[A-Za-z0-9]{37,}\b", 0, ("r8_",)),
    ("Groq API Key", "ai", "HIGH", r"\bgsk_[A-Za-z0-9]{48,}\b", 0, ("gsk_",)),
    ("npm Access Token", "package", "CRITICAL", r"\bnpm_[A-Za-z0-9]{36}\b", 0, ("npm_",)),
    ("PyPI Upload Token", "package", "CRITICAL", r"\bpypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", 0, ("pypi-",)),
    ("RubyGems API Key", "package", "HIGH", r"\brubygems_[a-f0-9]{48}\b", 0, ("rubygems_",)),
    ("Docker Hub Token", "package", "HIGH", r"\bdckr_pat_[A-Za-z0-9_-]{27}", 0, ("dckr_pat_",)),
    ("NuGet API Key", "package", "HIGH", r"\boy2[a-z0-9]{43}\b", 0, ("oy2",)),
    ("Shopify Access Token", "saas", "HIGH", r"\bshp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}\b", 0, ("shpat_", "shpca_", "shppa_", "shpss_")),
    ("Atlassian API Token", "saas", "HIGH", r"\bATATT3[A-Za-z0-9_=-]{50,}", 0, ("ATATT3",)),
    ("Linear API Key", "saas", "HIGH", r"\blin_api_[A-Za-z0-9]{40}\b", 0, ("lin_api_",)),
    ("Notion Integration Token", "saas", "HIGH", r"\bntn_[A-Za-z0-9]{40,}\b", 0, ("ntn_",)),
    ("Postman API Key", "saas", "HIGH", r"\bPMAK-[a-f0-9]{24}-[a-f0-9]{34}\b", 0, ("PMAK-",)),
    ("New Relic Key", "saas", "HIGH", r"\bNRAK-[A-Z0-9]{27}\b", 0, ("NRAK-",)),
    ("Sentry Auth Token", "saas", "HIGH", r"\bsntrys_[A-Za-z0-9+/=_-]{40,}", 0, ("sntrys_",)),
    ("Databricks Token", "saas", "HIGH", r"\bdapi[a-f0-9]{32}\b", 0, ("dapi",)),
    ("Grafana Token", "saas", "HIGH", r"\bgl(?:c|sa)_[A-Za-z0-9+/=_]{32,}", 0, ("glc_", "glsa_")),
    ("Vault Token", "saas", "HIGH", r"\bhvs\.[A-Za-z0-9_-]{24,}", 0, ("hvs.",)),
]
