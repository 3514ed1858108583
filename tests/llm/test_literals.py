import random
import re
from re import _constants as C
from re import _parser

import pytest

from mooring.llm import residue as R
from mooring.llm.literals import Gate, literals


def strings(seq, rng):
    """A random string for each way through a pattern, taken apart at its alternatives."""
    out = [""]
    for op, av in seq:
        if op is C.LITERAL:
            own = [chr(av)]
        elif op is C.BRANCH:
            own = [s for p in av[1] for s in strings(p, rng)]
        elif op is C.SUBPATTERN:
            own = strings(av[3], rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            own = ["".join(rng.choice(strings(av[2], rng)) for _ in range(n)) for n in {av[0], min(av[1], av[0] + 1)}] + [s * max(av[0], 1) for s in strings(av[2], rng)]
        elif op is C.IN:
            word = {C.CATEGORY_SPACE: " ", C.CATEGORY_DIGIT: "4", C.CATEGORY_WORD: "w", C.CATEGORY_NOT_WORD: " ", C.CATEGORY_NOT_SPACE: "x"}
            own = ["x "[rng.random() < 0.5]] if av[0][0] is C.NEGATE else [chr(x) if o is C.LITERAL else chr(x[0]) if o is C.RANGE else word[x] for o, x in av]
        elif op is C.ANY:
            own = [" "]
        else:
            own = [""]
        both = [a + b for a in out for b in own]
        out = both if len(both) <= 400 else [rng.choice(out) + b for b in own for _ in range(1 + 200 // len(own))]
    return out


@pytest.mark.parametrize("i", range(len(R._FIRST)))
def test_every_alternative_passes_the_gate(i):
    p, rng = R._FIRST[i], random.Random(i)
    found = {s for s in strings(_parser.parse(p.pattern, p.flags), rng) if p.search(s)}
    assert len(found) > 5
    for s in found:
        for t in (s, s.upper(), s.lower(), s.replace("s", "ſ").replace("i", "ı")):
            assert not p.search(t) or R._gate()(t) >> i & 1, t


def test_literals():
    assert literals(re.compile(r"\b(?:is|was)\s+(?:down|off)\b|gone")) == [[{"is", "was"}, {"down", "off"}], [{"gone"}]]
    with pytest.raises(ValueError):
        literals(re.compile(r"\d+|gone"))
    gate = Gate([literals(re.compile(r"a\s+kind", re.I)), literals(re.compile("other"))])
    assert [gate(x) for x in ("A KIND", "a", "kin", "another kind", "", "a Kınd")] == [1, 0, 0, 3, 0, 3]


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Checking if the site connection is secure", "check"), ("The site is currently down.", "error"), ("Could not load the page.", "error"), ("406 Not Acceptable", "error"), ("414 URI Too Long", "error"), ("409: Conflict", "error"),
        ("{{id}}", "placeholder"), ("{{q}}", "placeholder"), ("< your name >", "placeholder"), ("[ insert x ]", "placeholder"), ("foo bar baz", "filler"), ("test test", "filler"), ("N/A N/A", "filler"), ("Write a reasoning trace here", "filler"),
    ],
)
def test_evidence_without_the_former_stems(text, kind):
    assert R.evidence(text) == [kind]
