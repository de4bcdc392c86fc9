"""Package ecosystems, licence classes, CVSS weights.

Fixed values: all entries below are part of the results.
"""

# --- fixed values -----------------------------------------------------------
# manifest basename -> ecosystem
MANIFESTS = [
    ("requirements.txt", "PyPI"),
    ("package.json", "npm"),
    ("go.mod", "Go"),
    ("Gemfile.lock", "RubyGems"),
    ("composer.lock", "Packagist"),
    ("Cargo.lock", "crates.io"),
    ("poetry.lock", "PyPI"),
]

# ecosystem, package-URL type, upgrade command ({pkg} and {fix} are filled in)
ECOSYSTEMS = [
    ("PyPI", "pypi", "pip install '{pkg}>={fix}'"),
    ("npm", "npm", "npm install {pkg}@{fix}"),
    ("Go", "golang", "go get {pkg}@v{fix} && go mod tidy"),
    ("RubyGems", "gem", "bundle update {pkg}"),
    ("crates.io", "cargo", "cargo update -p {pkg} --precise {fix}"),
    ("Packagist", "composer", "composer require {pkg}:^{fix}"),
]

NO_FIX_TEXT = "No fixed version yet — assess exploitability or replace the package."
NO_SUMMARY_TEXT = "No summary available."

# ecosystem names accepted in an ad-hoc "[ecosystem:]name@version" lookup
ECOSYSTEM_ALIASES = {
    "pypi": "PyPI", "pip": "PyPI", "npm": "npm", "go": "Go", "rubygems": "RubyGems", "gem": "RubyGems",
    "crates": "crates.io", "cargo": "crates.io", "packagist": "Packagist", "composer": "Packagist",
}

STRONG_COPYLEFT = ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
                   "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]
WEAK_COPYLEFT = ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
                 "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1"]
NO_LICENCE = ["", "UNKNOWN", "NOASSERTION", "NONE"]
LICENCE_REASONS = {
    "none": "No license metadata found — verify usage rights manually.",
    "strong": "%s is a strong copyleft license — may require releasing source of derivative/linked works.",
    "weak": "%s is a weak copyleft / reciprocal license — review obligations for modifications and distribution.",
}

# CVSS v3.x base metric weights (public specification, section 7.4)
CVSS3_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
CVSS3_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}

LOOKUP_BATCH = 100
# --- end of fixed values ----------------------------------------------------
