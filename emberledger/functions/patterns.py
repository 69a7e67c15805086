"""Regular expressions assembled from word lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}\-&#~])")


def quote(text: str) -> str:
    """Escape a literal for Java and RE2 alike."""
    return _SPECIAL.sub(r"\\\1", text)


def any_of(names: Sequence[str]) -> str:
    """Alternation that prefers the longest name at a position."""
    return "|".join(quote(n) for n in sorted(names, key=len, reverse=True))
