"""Regular expressions in SQL text, with the meaning that the catalogues assume.

The patterns are written for an engine where classes are Unicode classes and where only a line
feed ends a line; in Java that is `(?Ud)`. A missing match or group is the empty string in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from ..catalogs.notation import exact, flags_and_pattern

#: Between a value and the label on the line below it.
BELOW = r"\s*\n\s*"
#: A value that goes over anything but line feeds: slow to look for from every place of a line.
WITHIN_LINE = re.compile(r"\((?:\[[^\]\\^][^\]\\]*\])?\[\^\\n[^\]]*\]\{\d+,\d+\}\??\)")


def text(value: str) -> str:
    """value as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Sequence[str]) -> str:
    """A SQL array of literals."""
    return f"array({', '.join(map(text, values))})" if values else "cast(array() as array<string>)"


def pattern(value: str | exact, flags: str | None = None) -> str:
    """A catalogue's pattern as a SQL literal; flags take the place of the entry's own."""
    own, body = flags_and_pattern(value)
    return text(f"(?Ud{own if flags is None else flags}){body}")


def tokens(body: str) -> Iterator[tuple[int, str]]:
    """Places and tokens of a pattern outside its character classes; a class is one token, an escaped character too."""
    at = 0
    while at < len(body):
        end = at + 1
        if body[at] == "\\":
            end += 1
        elif body[at] == "[":
            end += body[end] == "^"
            end += body[end] == "]"
            while body[end] != "]":
                end += 1 + (body[end] == "\\")
            end += 1
        elif body.startswith("(?", at):
            end = at + (4 if body.startswith("(?<", at) else 3)
        yield at, body[at:end]
        at = end


def groups_in(value: str | exact) -> int:
    """Capturing groups of a pattern."""
    return sum(token == "(" for _, token in tokens(flags_and_pattern(value)[1]))


def looks_around(value: str | exact) -> bool:
    """Whether a match depends on what is around it, so that the matched text alone may not match in the same way."""
    return any(token in ("^", "$", r"\b", r"\B") or token.startswith(("(?=", "(?!", "(?<")) for _, token in tokens(flags_and_pattern(value)[1]))


def label_below(value: str | exact) -> tuple[str, str] | None:
    """Value and label of a pattern "value, line feed, label" whose label holds no groups; else None."""
    body, depth, cut = flags_and_pattern(value)[1], 0, None
    for at, token in tokens(body):
        if depth == 0 and token == "|":
            return None
        if depth == 0 and cut is None and body.startswith(BELOW, at):
            cut = at
        depth += token.startswith("(") - (token == ")")
    if not cut or groups_in(body[cut:]) or body[cut + len(BELOW) :] == "":
        return None
    return body[:cut], body[cut + len(BELOW) :]


def quick(value: str | exact, flags: str | None = None) -> str:
    """The pattern as a SQL literal, with the same matches; where a line is not followed by the label, its places are left at once."""
    parts = label_below(value)
    if parts is None or not WITHIN_LINE.fullmatch(parts[0]):
        return pattern(value, flags)
    own, body = flags_and_pattern(value)
    return text(rf"(?Ud{own if flags is None else flags})(?=[^\n]*+\n\s*{parts[1]}){body}")


def strip(sql: str) -> str:
    """Without white space of any kind at both ends."""
    return f"regexp_replace({sql}, {text(r'(?U)^\s+|\s+$')}, '')"


def hits(source: str, value: str | exact, flags: str | None = None) -> str:
    """An array of structs raw, a, b, c: all matches of a pattern, with its first three groups ('' if there are fewer).

    Groups are taken from a match's own text, unless the pattern looks around it.
    """
    p, n = quick(value, flags), groups_in(value)
    raws = f"regexp_extract_all({source}, {p}, 0)"
    if n == 0:
        return f"transform({raws}, x -> named_struct('raw', x, 'a', x, 'b', '', 'c', ''))"
    if not looks_around(value):
        own = pattern(value, flags)
        parts = ", ".join(f"'{name}', " + (f"regexp_extract(x, {own}, {k})" if k <= n else "''") for k, name in enumerate("abc", 1))
        return f"transform({raws}, x -> named_struct('raw', x, {parts}))"
    alls = ", ".join(f"regexp_extract_all({source}, {p}, {k})" for k in range(min(n, 3) + 1))
    parts = ", ".join(f"'{name}', " + (f"x.`{k}`" if k <= n else "''") for k, name in enumerate("abc", 1))
    return f"transform(arrays_zip({alls}), x -> named_struct('raw', x.`0`, {parts}))"


def first(source: str, values: Sequence[str | exact], accept: str = "true", marks: Sequence[str] = (), lower: str = "") -> str:
    """The first hit h that `accept` holds for, pattern by pattern; null if there is none.

    marks: lower-case parts of which every match holds one; texts without any of them (in the column
    `lower`) are not searched. A value above its label is only looked for where the label begins a
    line, and groups that need a search of their own only where the pattern matches at all.
    """
    each = []
    for v in values:
        found, tests, parts = f"try_element_at(filter({hits(source, v)}, h -> {accept}), 1)", [], label_below(v)
        if parts is not None:
            tests.append(f"regexp_like({source}, {text(rf'(?Ud{flags_and_pattern(v)[0]})\n\s*{parts[1]}')})")
        if looks_around(v):
            tests.append(f"regexp_like({source}, {quick(v)})")
        each.append(f"if({' and '.join(tests)}, {found}, null)" if tests else found)
    found = each[0] if len(each) == 1 else f"coalesce({', '.join(each)})"
    return f"if({contains_any(lower, marks)}, {found}, null)" if marks else found


def like(source: str, value: str | exact, flags: str | None = None) -> str:
    return f"regexp_like({source}, {pattern(value, flags)})"


def replaced(source: str, value: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({source}, {pattern(value, flags)}, {text(by)})"


def starts_with_any(source: str, starts: Sequence[str]) -> str:
    return "(" + " or ".join(f"startswith({source}, {text(s)})" for s in starts) + ")"


def contains_any(source: str, parts: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({source}, {text(p)})" for p in parts) + ")"
