"""Route patterns: Java syntax, whole-string matches and named groups."""

from __future__ import annotations

import re

_NAMED = re.compile(r"\(\?<([a-zA-Z][a-zA-Z0-9]*)>")
_PYTHON_NAMED = re.compile(r"\(\?P<([a-zA-Z][a-zA-Z0-9]*)>")


def java_pattern(pattern: str) -> str:
    """`(?P<name>…)` as the `(?<name>…)` that Spark's regular expressions take."""
    return _PYTHON_NAMED.sub(r"(?<\1>", pattern)


def anchored(pattern: str) -> str:
    return rf"\A(?:{java_pattern(pattern)})\z"


def _marks(pattern: str):
    """Positions and characters outside escapes and character classes."""
    at, depth, quoted = 0, 0, False
    while at < len(pattern):
        if pattern.startswith("\\E" if quoted else "\\Q", at):
            quoted = not quoted
            at += 2
            continue
        char = pattern[at]
        if quoted:
            at += 1
            continue
        if char == "\\":
            at += 2
            continue
        if char == "[":
            depth += 1
        elif char == "]" and depth:
            depth -= 1
        elif not depth:
            yield at, char
        at += 1


def group_numbers(pattern: str) -> dict[str, int]:
    """Number of each named group, counting every capturing parenthesis."""
    pattern = java_pattern(pattern)
    numbers, count = {}, 0
    for at, char in _marks(pattern):
        if char != "(":
            continue
        named = _NAMED.match(pattern, at)
        if named:
            count += 1
            numbers[named.group(1)] = count
        elif not pattern.startswith("(?", at):
            count += 1
    return numbers


def took_part(pattern: str, group: str) -> str:
    """A pattern for `url + newline + url` that finds something only if `group` took part in the match.

    The first copy is matched whole and never reconsidered; a back-reference to a group that took
    no part fails in Java, one that matched finds its text in the second copy.
    """
    pattern = java_pattern(pattern)
    ends = {at for at, char in _marks(pattern) if char == "$"}
    ended = "".join(r"(?=\n|\z)" if at in ends else char for at, char in enumerate(pattern))
    return rf"\A(?>(?:{ended})\n)(?s:.*?)\k<{group}>"
