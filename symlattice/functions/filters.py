"""Symbol filters: globs, lists and their combinations, compiled to Column conditions.

Grammar: expressions are joined by ``|``, which binds weaker than ``&``;
``!`` negates; parentheses group; ``:`` and a name refer to a list of symbols; any
other word is a glob. White space separates only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    pass


def glob_regex(glob: str) -> str:
    """A regular expression for POSIX fnmatch without flags: ``*`` and ``?`` match anything, also ``/`` and leading dots."""
    out, i = ["(?s)^"], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[" and (end := _closing(glob, i)) is not None:
            body, i = glob[i:end], end + 1
            no = body[0] in "!^"
            body = body[1:] if no else body
            ranges = [x for x in re.findall(r"(?s).-.|.", body) if len(x) < 3 or x[0] <= x[2]]  # a range that ends before it begins has no members
            members = "".join("-".join(map(_member, (x[0], x[2]))) if len(x) == 3 else _member(x) for x in ranges)
            out.append(f"[{'^' * no}{members}]" if members else "." if no else "(?!)")
        else:
            out.append(re.escape(c))
    return "".join(out) + "$"


def _member(c: str) -> str:
    return "\\" + c if c in "\\[]&~^-" else c


def _closing(glob: str, at: int) -> int | None:
    j = at + (at < len(glob) and glob[at] in "!^")
    j += j < len(glob) and glob[j] == "]"  # a bracket that comes first is a member
    j = glob.find("]", j)
    return None if j < 0 else j


def matches(column: Column, glob: str) -> Column:
    """The condition; plain prefixes and suffixes become startswith and endswith, which scans can use."""
    plain = glob.strip("*")
    if not re.search(r"[*?\[\\]", plain):
        if "*" not in glob:
            return column == glob
        if glob == plain + "*":
            return column.startswith(plain)
        if glob == "*" + plain:
            return column.endswith(plain)
    return column.rlike(glob_regex(glob))


def read_list(text: str) -> list[str]:
    """Symbols of an INI-like list: lines of the sections whose name ends in ``list``, without blanks and lines that begin with #."""
    out, inside = [], False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("#"):
            continue
        if line.startswith("[") and line.endswith("]"):
            inside = line[1:-1].endswith("list")
        elif line and inside:
            out.append(line)
    return sorted(set(out))


def _words(text: str) -> list[str]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()!|&:":
            out.append(c)
            i += 1
        else:
            j = i
            while j < len(text) and not text[j].isspace() and text[j] not in "()!|&:":
                j += 1
            out.append(text[i:j])
            i = j
    return out


def compile_filter(expression: str, column: Column, lists: dict[str, list[str]] | None = None) -> Column:
    """The condition of an expression; lists holds the symbols of each ``:name``."""
    words, lists = _words(expression), lists or {}
    at = 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def chain(sign, inner, join) -> Column:
        nonlocal at
        out = inner()
        while peek() == sign:
            at += 1
            out = join(out, inner())
        return out

    def disjunction() -> Column:
        return chain("|", conjunction, lambda a, b: a | b)

    def conjunction() -> Column:
        return chain("&", atom, lambda a, b: a & b)

    def atom() -> Column:
        nonlocal at
        w = peek()
        if w is None:
            raise FilterError("expression ends early")
        at += 1
        if w == "!":
            return ~atom()
        if w == "(":
            inner = disjunction()
            if peek() != ")":
                raise FilterError("missing )")
            at += 1
            return inner
        if w in ")|&":
            raise FilterError(f"unexpected {w}")
        if w == ":":
            name = peek()
            if name is None or name in "()!|&:":
                raise FilterError("missing name after :")
            at += 1
            if name not in lists:
                raise FilterError(f"no list {name}")
            return column.isin(lists[name])
        return matches(column, w)

    out = disjunction()
    if peek() is not None:
        raise FilterError(f"unexpected {peek()}")
    return out
