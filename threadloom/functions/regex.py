"""One pattern text, two dialects.

Java's ``\\b`` treats accented letters as word characters while ``\\w`` does
not, so a word boundary is spelled out with ASCII look-arounds; ``$`` becomes
``\\z`` because Java also accepts a final line break before the end.

Most rules are unanchored alternations that match nowhere in a text. Two
rewrites keep them cheap at every position that cannot start a match: the
possible first characters are tested before anything else, and neighbouring
alternatives that begin with a boundary share one boundary test.
"""

import re._constants as op
import re._parser as parser
from functools import cache

_WORD = "[A-Za-z0-9_]"
_LEADING = f"(?<!{_WORD})"
_FULL = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_CLASSES = {
    op.CATEGORY_DIGIT: "0123456789",
    op.CATEGORY_WORD: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_",
}


@cache
def java(pattern: str, flags: str = "") -> str:
    """Pattern for Spark's ``rlike`` / ``regexp_*`` functions."""
    parts = _alternatives(pattern)
    # those at the start of a line fail at once elsewhere; the others look at the first character
    anchored = next((i for i, a in enumerate(parts) if not a.startswith("^")), len(parts))
    bodies = [_translate(a, flags) for a in parts[:anchored]]
    if rest := parts[anchored:]:
        body = "|".join(_share_boundary([_translate(a, flags) for a in rest]))
        first = _first_characters("|".join(rest), "i" in flags)
        bodies.append(f"(?=[{first}])(?:{body})" if first else body)
    return (f"(?{flags})" if flags else "") + "|".join(bodies)


def _alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _share_boundary(parts: list[str]) -> list[str]:
    out, run = [], []
    for part in [*parts, None]:
        if part is not None and part.startswith(_LEADING):
            run.append(part[len(_LEADING) :])
            continue
        if run:
            out.append(_LEADING + (run[0] if len(run) == 1 else f"(?:{'|'.join(run)})"))
            run = []
        if part is not None:
            out.append(part)
    return out


def _translate(pattern: str, flags: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            before = pattern[:i]
            leading = not before or before[-1] in "|(" or before.endswith("(?:")
            out.append(_LEADING if leading and _starts_a_word(pattern[i + 2 :]) else _FULL)
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            ch = pattern[i]
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "]" and in_class:
                in_class = False
            out.append(r"\z" if ch == "$" and not in_class and "m" not in flags else ch)
            i += 1
    return "".join(out)


def _starts_a_word(rest: str) -> bool:
    """A boundary before a word character only has to look back; before "." or "-" it has to be tested in full."""
    if not rest.startswith("["):
        return True
    chars, _ = _first(parser.parse(rest[: rest.index("]") + 1]))
    return chars is not None and chars <= set(_CLASSES[op.CATEGORY_WORD])


def _first_characters(pattern: str, ignore_case: bool) -> str | None:
    """Character class of everything a match can start with; None when that is not a small ASCII set."""
    found, empty = _first(parser.parse(pattern))
    if found is None or empty:
        return None
    if ignore_case:
        found = {c for x in found for c in (x.lower(), x.upper())}
    if any(ord(c) > 127 for c in found):
        return None
    return "".join(("\\" + c) if c in "\\]^-[&" else c for c in sorted(found))


def _first(items) -> tuple[set | None, bool]:
    """First characters of a parsed sequence, and whether it can match the empty string."""
    seen = set()
    for code, arg in items:
        chars, empty = _first_of(code, arg)
        if chars is None:
            return None, False
        seen |= chars
        if not empty:
            return seen, False
    return seen, True


def _first_of(code, arg) -> tuple[set | None, bool]:
    if code is op.LITERAL:
        return {chr(arg)}, False
    if code is op.IN:
        chars = set()
        for kind, value in arg:
            if kind is op.LITERAL:
                chars.add(chr(value))
            elif kind is op.RANGE:
                chars |= {chr(c) for c in range(value[0], value[1] + 1)}
            elif kind is op.CATEGORY and value in _CLASSES:
                chars |= set(_CLASSES[value])
            else:
                return None, False
        return chars, False
    if code is op.BRANCH:
        options = [_first(branch) for branch in arg[1]]
        if any(chars is None for chars, _ in options):
            return None, False
        return set().union(*[chars for chars, _ in options]), any(empty for _, empty in options)
    if code is op.SUBPATTERN:
        chars, empty = _first(arg[3])
        if chars is not None and arg[1]:  # a group with its own flags: (?i:...)
            chars = {c for x in chars for c in (x.lower(), x.upper())}
        return chars, empty
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        chars, empty = _first(arg[2])
        return chars, empty or arg[0] == 0
    if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return set(), True
    return None, False


def re2(pattern: str, flags: str = "") -> str:
    """Pattern for the SQL checks; RE2 word boundaries are already ASCII."""
    return (f"(?{flags})" if flags else "") + pattern


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
