"""Patterns of ECMAScript flavour for the Java engine, and ordered replacements."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # Java's own \b counts accented letters as word characters
AFTER_NONE, BEFORE_NONE = r"(?<!\w)", r"(?!\w)"  # the same where a word character surely follows, or surely precedes
SPACE = r"\s\p{Z}\x{FEFF}"
#: One word character at least: a letter, a digit, \d, \w, or a class of such.
_WORD = r"(?:[A-Za-z0-9_]|\\[dw]|\[(?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\[dw])+\])"


def branches(inner: str) -> list[str]:
    """Alternatives at the top level of a group."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(inner):
        if inner[i] == "\\":
            i += 1
        elif inner[i] in "([":
            depth += 1
        elif inner[i] in ")]":
            depth -= 1
        elif inner[i] == "|" and depth == 0:
            out.append(inner[start:i])
            start = i + 1
        i += 1
    return [*out, inner[start:]]


def _group(pattern: str) -> tuple[str, str] | None:
    """(inner part, what follows) of the plain group that pattern begins with."""
    depth, i = 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "(":
            depth += 1
        elif pattern[i] == ")":
            depth -= 1
            if depth == 0:
                inner = pattern[1:i].removeprefix("?:")
                return None if inner.startswith("?") or "[" in inner and re.search(r"\[[^\]]*[()|]", inner) else (inner, pattern[i + 1 :])
        i += 1
    return None


def starts_in_word(pattern: str) -> bool:
    """Whether what the pattern matches surely begins with a word character."""
    if pattern.startswith("("):
        found = _group(pattern)
        return found is not None and not re.match(r"[?*{]", found[1]) and all(map(starts_in_word, branches(found[0])))
    return re.match(_WORD + r"(?![?*]|\{0)", pattern) is not None


def ends_in_word(pattern: str) -> bool:
    """Whether what the pattern matches surely ends in a word character."""
    if pattern.endswith(")") and not pattern.endswith("\\)"):
        starts = [i for i, c in enumerate(pattern) if c == "(" and (found := _group(pattern[i:])) and found[1] == ""]
        return bool(starts) and all(map(ends_in_word, branches(_group(pattern[starts[0] :])[0])))
    return re.search(rf"(?<!\\){_WORD}\+?$", pattern) is not None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java(pattern: str) -> str:
    """\\b over ASCII, \\s with all Unicode spaces, [^] as any character."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern[i : i + 3] == "[^]":
            out.append(r"[\s\S]")
            i += 3
        elif two == r"\b" and not inside:
            out.append(AFTER_NONE if starts_in_word(pattern[i + 2 :]) else BEFORE_NONE if ends_in_word(pattern[:i]) else BOUNDARY)
            i += 2
        elif two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = {"[": True, "]": False}.get(pattern[i], inside)
            out.append(pattern[i])
            i += 1
    return "".join(out)


def where(text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(text) where test(text) holds, which must be so for all texts that change alters; else the text as it is."""
    return let(text, lambda t: F.when(test(t), change(t)).otherwise(t))


def holds(*signs: str, any_case: bool = False) -> Callable[[Column], Column]:
    """Whether a text holds one of the signs; any_case: signs in lower case."""
    return lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(t) if any_case else t, F.lit(s)) for s in signs])


def matches(text: Column, pattern: str, any_case: bool = True) -> Column:
    return text.rlike(("(?i)" if any_case else "") + java(pattern))


def any_of(text: Column, patterns: tuple[str, ...], any_case: bool = True) -> Column:
    """Whether one of the patterns is found: a single pass with an alternation. Those that begin with a word share one test of its start, and so do those that begin a text."""
    first = [p[1:] for p in patterns if p.startswith("^") and len(branches(p)) == 1]
    if len(first) > 1:
        rest = tuple(p for p in patterns if not (p.startswith("^") and len(branches(p)) == 1))
        patterns = (*rest, "^(?:" + "|".join(first) + ")")
    words = [p[2:] for p in patterns if p.startswith(r"\b") and len(branches(p)) == 1 and starts_in_word(p[2:])]
    others = [f"(?:{p})" for p in patterns if not (p.startswith(r"\b") and len(branches(p)) == 1 and starts_in_word(p[2:]))]
    return matches(text, "|".join([*([r"\b(?:" + "|".join(words) + ")"] if words else []), *others]), any_case)


def replaced(text: Column, steps: tuple[tuple[str, str], ...], flags: str = "i") -> Column:
    """All replacements in order; $n names a group."""
    lead = f"(?{flags})" if flags else ""
    return reduce(lambda c, s: F.regexp_replace(c, lead + java(s[0]), s[1]), steps, text)


def replaced_where_found(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    """All replacements in order, in any case; a text that no pattern is found in stays, for the price of one pass."""
    return let(text, lambda t: F.when(any_of(t, tuple(p for p, _ in steps)), replaced(t, steps)).otherwise(t))


def first_label(text: Column, table: tuple[tuple[str, object], ...], otherwise) -> Column:
    """Value of the first pattern found. One pass tells whether there is any."""

    def labelled(t: Column) -> Column:
        out = F.when(~any_of(t, tuple(p for p, _ in table)), otherwise)
        for pattern, value in table[:-1]:
            out = out.when(matches(t, pattern), value)
        return out.otherwise(table[-1][1])

    return let(text, lambda t: F.when(t.isNull(), otherwise).otherwise(labelled(t)))


def replaced_sql(text: str, steps: tuple[tuple[str, str], ...], flags: str = "i") -> str:
    for pattern, to in steps:
        to = to.replace("$", "\\")
        pattern = "(?m)" + pattern if "m" in flags else pattern  # the engine's own m option is about the dot
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, '{'g' + flags.replace('m', '')}')"
    return text


def any_of_sql(text: str, patterns: tuple[str, ...], flags: str = "i") -> str:
    return "(" + " or ".join(f"regexp_matches({text}, {quoted(p)}{f", '{flags}'" if flags else ''})" for p in patterns) + ")"


def quoted(text: str) -> str:
    body = "'" + text.replace("'", "''") + "'"
    return body if "\n" not in text else "(" + " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n")) + ")"
