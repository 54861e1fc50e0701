"""Matches at the places of signs against the patterns' own searches."""

import random

import pytest

from reqloom.functions.families import CHUNK_HEADINGS, FAMILIES, HEADINGS, SPLIT_HEADING
from reqloom.functions.signs import Signs, pattern, sought
from reqloom.operators import extraction as X

PATTERNS = [p for _, _, hits, marks in FAMILIES for p in (*hits, *(m[0] for m in marks))] + [*HEADINGS, *CHUNK_HEADINGS, SPLIT_HEADING]
PARTS = ["3.1.1 ", "4.2 ", "1.0 Intro", "2.0: Scope", "Section 5: Need", "section 7 - ab Title", "II.A.3 ", "iv. X", "III. Title", "A.1.2 ", "B.3 ", "B.3. ", "C4. ", "[Col 1] D5. | [Col 2] ", "(1) ", "(b) ", "(iv) ", "3) It", "b) ", "a. Out", "ii. It", "[REQ-12] ", "[r3] ",
         "REQ-9: ", "req7. ", "[3.4] ", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\n \n", "\u00a0", "plain", ". ", "? ", "! ", "12", ".", "6\n\nMajor Heading", "7 SPECIAL TERMS", "A. Company", "Appendix B: Forms", "SECTION C Terms Here", "# B. DELIVERY", "word ", "x" * 30, "É", "٣.1.2 ", "1.2.3\n", "5.0\n6.0 Title", "Hello. 2) A", "Note. viii. B"]


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(150)]


@pytest.mark.parametrize("seed", range(4))
def test_places(seed):
    for text in texts(seed):
        signs, cut = Signs(text), sorted(random.Random(seed).choices(range(len(text) + 1), k=2))
        for p in PATTERNS:
            assert [(m.span(), m.groups()) for m in signs.finditer(p)] == [(m.span(), m.groups()) for m in pattern(p).finditer(text)], (p, text)
            want, at = [], cut[0]
            while (m := pattern(p).search(text, at)) and m.start() < cut[1]:
                want.append((m.span(), m.groups()))
                at = m.start() + 1
            assert [(m.span(), m.groups()) for m in signs.everywhere(p, *cut)] == want, (p, text)


def test_few_patterns_are_searched_for_as_they_are():
    assert sum(not sought(p)[1] for p in PATTERNS) <= 12


@pytest.mark.parametrize("seed", range(3))
def test_questions(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice(["A", "b", "?", ".", "!", " ", "3.1 ", "\n", "Is it"]) for _ in range(40))
        assert [(at, said) for at, said, _ in X.questions_of(text)] == [(m.start(), m[0].strip()) for m in X.QUESTION.finditer(text)]
