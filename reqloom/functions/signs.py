"""Where patterns of numbering can match: beginnings of lines, ends of sentences, numbers and brackets behind white space.

A pattern that begins in one of these ways can match at few places of a text. They are found once for all patterns, by
searches for plain signs, and a pattern is tried at those only whose first signs it can take. Matches are those of the
pattern's own search; a pattern of another form is searched for as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

LINE, SENTENCE, SPACED = r"(?:^|\n)\s*", r"[.?!]\s+", r"(?:^|\s)"
#: What follows the beginning, and the name of the list of places that it can stand at; the first that fits.
AFTER = {
    LINE: ((r"\(?\\d", "digit"), (r"\\\(", "round"), (r"\(?\[A-Z\]\)?\\\.", "A."), (r"\(?\[A-Z\]\)?\(?\\d", "A1"), (r"\(?\[a-z\]\)?\\\.", "a."), (r"\(?\[a-z\]\)?\\\)", "a)"),
           (r"\((?:\?:)?(?:I\{1,3\}\|IV|i\{1,3\}\|iv)\|", "roman"), (r"\(?REQ", "req"), (r"\(\?:SECTION\|Section\)\\s", "section"), (r"\(\?:SECTION\|Section\|Appendix\)\?\\s\*\(\[A-Z\]\)\[\\\.\\s:\]\+|\(\[A-Z\]\)\[\.:\\-\)\\s\]\+", "head")),
    SENTENCE: ((r"\\\(\(?\\d\+\)?\\\)|\(?\\d\+\)?\\\)|\(?\[A-Z\]\)?\\[.)]|\(?\[a-z\]\)?\\\.|\((?:\?:)?i\{1,3\}\|iv\|vi\{0,3\}", "sentence"),),
    SPACED: ((r"\(\\d\+\)\\\.(?:\(?\\d|0)", "number"), (r"\\\[", "bracket")),
}
_START, _RUN = re.compile(r"\s*+", re.ASCII), re.compile(r"\n\s*+", re.ASCII)
_SENTENCE = re.compile(r"[.?!]\s++(?=\(\d|\d++\)|[A-Za-z]{1,4}[.)])", re.ASCII)
_NUMBER = re.compile(r"\d(?<!\d\d)\d*+\.(?=\d)", re.ASCII)
_SPACE = " \t\n\r\f\v"


@cache
def pattern(p: str) -> re.Pattern:
    return re.compile(p, re.MULTILINE | re.ASCII)


@cache
def sought(p: str) -> tuple[re.Pattern, str, str]:
    """The pattern, how it begins, and the list of places for it; two blanks where it is of another form."""
    flags, rest = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
    for lead, forms in AFTER.items():
        if rest.startswith(lead):
            name = next((name for form, name in forms if re.match(form, rest[len(lead) :])), "")
            if name and (not flags or name in ("roman", "req", "section", "sentence", "bracket", "round")):
                return pattern(p), lead, name
    return pattern(p), "", ""


class Signs:
    """A text with its places."""

    def __init__(self, text: str):
        self.text = text
        self._lists: dict[str, list] = {}

    def _lines(self) -> None:
        """(start of the white space with the line's beginning, its first sign) by kinds of first signs."""
        text, n = self.text, len(self.text)
        lists = {name: [] for _, name in AFTER[LINE]}
        first = _START.match(text).end()
        runs = [(0, first), *((m.start(), m.end()) for m in _RUN.finditer(text, first))]
        for run, head in runs:
            if head >= n:
                continue
            c, after = text[head], text[head + 1 : head + 2]
            if "0" <= c <= "9":
                lists["digit"].append((run, head))
            elif c == "(":
                lists["round"].append((run, head))
            elif "A" <= c <= "Z" or "a" <= c <= "z":
                large = c <= "Z"
                if after == ".":
                    lists["A." if large else "a."].append((run, head))
                elif after == ")" and not large:
                    lists["a)"].append((run, head))
                elif large and "0" <= after <= "9":
                    lists["A1"].append((run, head))
                if c in "IVXivx":
                    lists["roman"].append((run, head))
                if c in "Rr":
                    lists["req"].append((run, head))
                if c in "Ss":
                    lists["section"].append((run, head))
                if large and (c in "SA" or after and after in ".:-)" + _SPACE):
                    lists["head"].append((run, head))
        self._lists |= lists

    def _at(self, lead: str, name: str) -> list:
        if name not in self._lists:
            text = self.text
            if lead == LINE:
                self._lines()
            elif lead == SENTENCE:
                self._lists[name] = [m.start() for m in _SENTENCE.finditer(text)]
            else:
                heads = (m.start() for m in (_NUMBER if name == "number" else pattern(r"\[")).finditer(text))
                self._lists[name] = [h for h in heads if h == 0 or text[h - 1] in _SPACE]
        return self._lists[name]

    def finditer(self, p: str) -> Iterator[re.Match]:
        """As the pattern's own finditer."""
        found, lead, name = sought(p)
        if not lead:
            if "#" not in p or "#" in self.text:
                yield from found.finditer(self.text)
            return
        text, match, at = self.text, found.match, 0
        for place in self._at(lead, name):
            if lead == LINE:
                start, head = place
                if at > start:
                    if at > head:
                        continue
                    start = at if text[at - 1] == "\n" else text.find("\n", at, head)
            elif lead == SENTENCE:
                start = place if at <= place else -1
            else:
                start = place - 1 if place and at < place else place if at <= place and (not place or text[place - 1] == "\n") else -1
            if start >= 0 and (m := match(text, start)):
                at = m.end()
                yield m

    def everywhere(self, p: str, lo: int, hi: int) -> Iterator[re.Match]:
        """A match at each place of text[lo:hi] where the pattern matches, whether or not another covers it."""
        found, lead, name = sought(p)
        text = self.text
        if not lead:
            at = lo
            while (m := found.search(text, at)) and m.start() < hi:
                yield m
                at = m.start() + 1
            return
        for place in self._at(lead, name):
            if lead == LINE:
                run, head = place
                if run >= hi or head < lo:
                    continue
                if not found.match(text, run):
                    continue
                starts = [s for s in range(max(run, lo), min(head + 1, hi)) if s == 0 or text[s - 1] == "\n" or (s < head and text[s] == "\n")]
            elif lead == SENTENCE:
                starts = [place]
            else:
                starts = [s for s in (place - 1, place) if s >= 0 and (s < place or s == 0 or text[s - 1] == "\n")]
            for s in starts:
                if lo <= s < hi and (m := found.match(text, s)):
                    yield m
