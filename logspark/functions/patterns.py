"""Globs and regular expressions as Java patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # another Python: patterns then go through Python itself
    _c = _parser = None


def glob_regex(glob: str) -> str:
    """A pattern for the whole of what a case-sensitive glob matches; / isn't special."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        end = glob.find("]", i + 1 + (glob[i : i + 1] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c in "_ /-" else "\\" + c)
    return "(?s)^" + "".join(out) + "$"


def matches_any(column: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether one of the globs matches; one * matches all that isn't null."""
    if "*" in globs:
        return column.isNotNull()
    if not globs:
        return F.lit(False)
    return F.coalesce(column.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)), F.lit(False))


def globbed(column: Column, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = ()) -> Column:
    """Any of include (none given: all) and none of exclude."""
    kept = matches_any(column, include) if include else F.lit(True)
    return kept & ~matches_any(column, exclude) if exclude else kept


#: What Python's classes hold, in Java's syntax: Java's own are ASCII only, or, with its Unicode flag, other sets.
_WORD, _DIGIT, _SPACE = r"\p{L}\p{N}_", r"\p{Nd}", r"\t\n\x0B\f\r\x1C-\x20\x85\xA0  -     　"
_ASCII_WORD, _ASCII_DIGIT, _ASCII_SPACE = "a-zA-Z0-9_", "0-9", r"\t\n\x0B\f\r\x20"


class _NoJava(Exception):
    """A part of a pattern that Java lacks."""


def _literal(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() else f"\\x{{{code:x}}}"


class _Translation:
    """Writes a parsed Python pattern in Java's syntax. Groups keep their numbers and lose their names, which Java restricts."""

    def __init__(self, pattern: str):
        self.parsed = _parser.parse(pattern)
        self.flags = self.parsed.state.flags

    def classes(self, flags: int) -> dict:
        ascii_ = flags & re.ASCII
        w, d, s = (_ASCII_WORD, _ASCII_DIGIT, _ASCII_SPACE) if ascii_ else (_WORD, _DIGIT, _SPACE)
        return {_c.CATEGORY_WORD: w, _c.CATEGORY_DIGIT: d, _c.CATEGORY_SPACE: s, _c.CATEGORY_NOT_WORD: f"[^{w}]", _c.CATEGORY_NOT_DIGIT: f"[^{d}]", _c.CATEGORY_NOT_SPACE: f"[^{s}]"}

    def whole(self) -> str:
        body = self.sequence(self.parsed, self.flags)
        if "(?<" in body:
            # Java looks behind by code points only in patterns with a character over U+FFFF; this one matches nothing
            body += "(?:|\U0001f600(?!))"
        return f"(?iu:{body})" if self.flags & re.IGNORECASE else body

    def sequence(self, items, flags: int) -> str:
        return "".join(self.one(op, arg, flags) for op, arg in items)

    def one(self, op, arg, flags: int) -> str:
        if op is _c.LITERAL:
            if arg > 127 and flags & re.IGNORECASE:
                raise _NoJava(op)  # the cases of some letters differ
            return _literal(arg)
        if op is _c.NOT_LITERAL:
            return f"[^{_literal(arg)}]"
        if op is _c.ANY:
            return "(?s:.)" if flags & re.DOTALL else "[^\\n]"
        if op is _c.IN:
            return self.members(arg, flags)
        if op is _c.AT:
            return self.place(arg, flags)
        if op is _c.BRANCH:
            return "(?:" + "|".join(self.sequence(x, flags) for x in arg[1]) + ")"
        if op is _c.SUBPATTERN:
            group, add, drop, inner = arg
            inside = (flags | add) & ~drop
            body = self.sequence(inner, inside)
            if (inside ^ flags) & re.IGNORECASE:
                body = f"(?{'' if inside & re.IGNORECASE else '-'}iu:{body})"
            return f"({body})" if group is not None else f"(?:{body})"
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
            low, high, inner = arg
            times = f"{{{low},{'' if high is _c.MAXREPEAT else high}}}"
            return f"(?:{self.sequence(inner, flags)}){times}" + {_c.MIN_REPEAT: "?", _c.POSSESSIVE_REPEAT: "+"}.get(op, "")
        if op is _c.GROUPREF:
            return f"(?:\\{arg})"
        if op in (_c.ASSERT, _c.ASSERT_NOT):
            way, inner = arg
            return f"(?{'<' if way < 0 else ''}{'=' if op is _c.ASSERT else '!'}{self.sequence(inner, flags)})"
        if op is _c.ATOMIC_GROUP:
            return f"(?>{self.sequence(arg, flags)})"
        raise _NoJava(op)

    def members(self, items, flags: int) -> str:
        own, negated = [], False
        for op, arg in items:
            if op is _c.NEGATE:
                negated = True
            elif op is _c.LITERAL:
                own.append(_literal(arg))
            elif op is _c.RANGE:
                own.append(f"{_literal(arg[0])}-{_literal(arg[1])}")
            elif op is _c.CATEGORY:
                own.append(self.classes(flags)[arg])
            else:
                raise _NoJava(op)
        inside = "[" + "".join(own) + "]"
        return f"(?:(?!{inside})(?s:.))" if negated else inside

    def place(self, at, flags: int) -> str:
        w = "[" + self.classes(flags)[_c.CATEGORY_WORD] + "]"
        if at is _c.AT_BEGINNING:
            return "(?<![^\\n])" if flags & re.MULTILINE else "\\A"
        if at is _c.AT_END:
            return "(?![^\\n])" if flags & re.MULTILINE else "(?=\\n?\\z)"
        if at is _c.AT_BEGINNING_STRING:
            return "\\A"
        if at is _c.AT_END_STRING:
            return "\\z"
        if at is _c.AT_BOUNDARY:
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
        if at is _c.AT_NON_BOUNDARY:
            return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
        raise _NoJava(at)


def java_regex(pattern: str) -> str | None:
    """A pattern in Java's syntax that matches what Python's `re` matches; None if there is no equivalent."""
    re.compile(pattern)
    if _parser is None:
        return None
    try:
        return _Translation(pattern).whole()
    except _NoJava:
        return None


def never_empty(pattern: str) -> bool:
    """Whether every match has a character: Java and Python treat empty matches differently."""
    return _parser is not None and _parser.parse(pattern).getwidth()[0] > 0


parse_template = getattr(_parser, "parse_template", None)


def groups_take_part(pattern: str) -> bool:
    """Whether every match has all groups: none is in an alternative or in what may be left out."""
    return _parser is not None and all(_always(_parser.parse(pattern)))


def _always(items, sure: bool = True):
    for op, arg in items:
        if op is _c.SUBPATTERN:
            if arg[0] is not None:
                yield sure
            yield from _always(arg[3], sure)
        elif op is _c.BRANCH:
            for x in arg[1]:
                yield from _always(x, False)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
            yield from _always(arg[2], sure and arg[0] > 0)
        elif op is _c.ASSERT:
            yield from _always(arg[1], sure)
        elif op is _c.ASSERT_NOT:
            yield from _always(arg[1], False)
        elif op is _c.ATOMIC_GROUP:
            yield from _always(arg, sure)
        elif op is _c.GROUPREF_EXISTS:
            for x in arg[1:]:
                yield from _always(x or (), False)


def found(c: Column, pattern: str, at_start: bool = False) -> Column:
    """Whether a pattern is found in a text (at_start: at its beginning; null: false); patterns that Java lacks go through Python, by vectors."""
    java = java_regex(pattern)
    if java is not None:
        return F.coalesce(c.rlike(f"\\A(?:{java})" if at_start else java), F.lit(False))
    search = re.compile(pattern).match if at_start else re.compile(pattern).search

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and search(t) is not None).astype(bool)

    return run(c)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, as Python's re has it; empty where there is no match or the group takes no part."""
    java = java_regex(pattern)
    if java is not None:
        return F.regexp_extract(c, java, group)
    search = re.compile(pattern).search

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else ((m := search(t)) and m.group(group)) or "")

    return run(c)


def replaced(c: Column, pattern: str, replacement: str) -> Column:
    """re.sub(pattern, replacement, c)."""
    java, new = java_regex(pattern), java_replacement(replacement)
    if java is not None and new is not None and never_empty(pattern):
        return F.regexp_replace(c, java, new)
    compiled = re.compile(pattern)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compiled.sub(replacement, t))

    return run(c)


def java_replacement(replacement: str) -> str | None:
    """A Python replacement with \\1 .. \\9 in Java's syntax; None if it uses more."""
    out, i = [], 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\" and i + 1 < len(replacement):
            n = replacement[i + 1]
            if n.isdigit() and n != "0" and not replacement[i + 2 : i + 3].isdigit():
                out.append(f"${n}")
            elif n == "\\":
                out.append("\\\\")
            else:
                return None
            i += 2
            continue
        out.append("\\" + c if c in "$\\" else c)
        i += 1
    return "".join(out)
