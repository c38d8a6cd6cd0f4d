"""Text that a regular expression needs: what every match must hold."""

from __future__ import annotations

import re
import warnings
from re import _constants as kinds
from re import _parser as parser

#: Letters of an index piece, and so the least length of needed text.
PIECE = 3

#: Lower-case texts of which every match holds at least one; None if nothing is known.
Needs = tuple[str, ...] | None

# Escapes that mean the same to Python, which parses here, and to Java, which matches.
_OTHER_ESCAPE = re.compile(r"\\(?![bBdDwWsS.()\[\]{}+*?^$|/\\-])", re.ASCII)
# Flags other than the one for case.
_FLAGS = re.compile(r"\(\?(?!i?[:)])[a-zA-Z-]+[:)]")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 '-.,")


def needed(pattern: str) -> Needs:
    """Texts of PIECE letters or more, one of which is in every match of ``pattern``, whatever the case.

    Only ASCII text counts, as only its case is ignored by Java's ``(?i)``.  Expressions with escapes that
    Python and Java read differently, with flags, or that Python cannot parse have no needed text.
    """
    if _OTHER_ESCAPE.search(pattern.replace("\\\\", "")):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = parser.parse(pattern)
    except re.error:
        return None
    if _FLAGS.search(pattern) or "&&" in pattern:
        return None
    return _of(parsed)


def _of(items: parser.SubPattern) -> Needs:
    """The best needed text of a sequence: the one whose shortest alternative is longest."""
    found: list[tuple[str, ...]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= PIECE:
            found.append((run,))
        run = ""

    for kind, value in items:
        if kind is kinds.LITERAL and chr(value).lower() in _PLAIN and value < 128:
            run += chr(value).lower()
            continue
        close()
        inner = None
        if kind is kinds.SUBPATTERN:
            inner = _of(value[3])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _of(value[2])
        elif kind is kinds.ATOMIC_GROUP:
            inner = _of(value)
        elif kind is kinds.BRANCH:
            parts = [_of(part) for part in value[1]]
            if all(parts):
                inner = tuple(sorted({text for part in parts for text in part}))
        if inner:
            found.append(inner)
    close()
    return max(found, key=lambda texts: min(map(len, texts)), default=None)
