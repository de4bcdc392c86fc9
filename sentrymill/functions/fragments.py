"""Many literal fragments looked for at once: one expression over a character trie instead of a search for each.

At each position of a text the expression tests one class of first characters and then follows one path of the trie, so its
time hardly grows with the number of fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

_END = ""


def _trie(fragments: Iterable[str]) -> dict:
    root: dict = {}
    for fragment in fragments:
        node = root
        for c in fragment:
            node = node.setdefault(c, {})
        node[_END] = {}
    return root


def _longest(node: dict) -> str:
    ways = [re.escape(c) + _longest(node[c]) for c in sorted(node) if c != _END]
    if not ways:
        return ""
    below = "|".join(ways)
    if _END in node:
        return f"(?:{below})?"
    return below if len(ways) == 1 else f"(?:{below})"


def every_regex(fragments: Iterable[str]) -> str:
    """Matches at every position where a fragment starts, overlapping ones too; group 1 is the longest fragment there.

    The other fragments that start at the position are the beginnings of that one.
    """
    root = _trie(fragments)
    first = "".join(re.escape(c) for c in sorted(root))
    return f"(?=[{first}])(?=({_longest(root)}))"


def beginnings(fragments: Iterable[str]) -> dict[str, list[str]]:
    """Each fragment with all fragments it begins with, itself included."""
    known = set(fragments)
    return {f: [f[:n] for n in range(1, len(f) + 1) if f[:n] in known] for f in known}
