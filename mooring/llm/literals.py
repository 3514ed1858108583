"""Gates derived from patterns: literals one of which every match must hold.

A gate is a superset by construction: it is read off the parsed pattern, so no
alternative can be forgotten. Literals hold no white space, as blanks may come
from what was taken out of a text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from re import _constants as C
from re import _parser

#: At most so many strings stand for a piece of a pattern.
STRINGS = 64


def _join(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= STRINGS else None


def _exact(op, av) -> set[str] | None:
    """All strings a piece matches, if they are few."""
    if op is C.LITERAL:
        return {chr(av)}
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}
    if op is C.IN:
        return {chr(x) for _, x in av} if all(o is C.LITERAL for o, _ in av) else None
    if op is C.SUBPATTERN:
        return _all(av[3])
    if op is C.BRANCH:
        parts = [_all(p) for p in av[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > STRINGS else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[1] <= 3:
        one, out, now = _all(av[2]), set(), {""}
        for i in range(av[1] + 1):
            if now is None or one is None:
                return None
            if i >= av[0]:
                out |= now
            now = _join(now, one)
        return out
    return None


def _all(seq) -> set[str] | None:
    out: set[str] | None = {""}
    for op, av in seq:
        piece = _exact(op, av)
        out = None if piece is None else _join(out, piece)
        if out is None:
            return None
    return out


def _words(strings: set[str]) -> set[str] | None:
    out = {max(s.split(), key=len, default="") for s in strings}
    return None if not out or "" in out else out


def _telling(found: list[set[str]]) -> set[str] | None:
    return max(found, key=lambda f: (min(min(map(len, f)), 5), -len(f)), default=None)


def _required(seq) -> list[set[str]]:
    """Sets of each of which every match of ``seq`` holds a literal."""
    found: list[set[str] | None] = []
    run: set[str] = {""}
    for op, av in seq:
        piece = _exact(op, av)
        both = None if piece is None else _join(run, piece)
        if both is not None:
            run = both
            continue
        found.append(_words(run))
        run = piece if piece is not None else {""}
        if op is C.SUBPATTERN:
            found += _required(av[3])
        elif op is C.BRANCH:
            parts = [_telling(_required(p)) for p in av[1]]
            found.append(None if None in parts else set().union(*parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0] >= 1:
            one = _all(av[2])
            found += [_words({s * av[0] for s in one})] if one else _required(av[2])
    return [f for f in [*found, _words(run)] if f]


def _alternatives(seq) -> list:
    rest = [x for x in seq if x[0] is not C.AT]
    if len(rest) == 1 and rest[0][0] is C.SUBPATTERN:
        return _alternatives(rest[0][1][3])
    if len(rest) == 1 and rest[0][0] is C.BRANCH:
        return [x for p in rest[0][1][1] for x in _alternatives(p)]
    return [seq]


def literals(pattern: re.Pattern) -> list[list[set[str]]]:
    """For each alternative of the pattern, sets of lower-case literals; a match of it, in whatever case, holds one of each set."""
    out = [[{x.lower() for x in f} for f in _required(p)] for p in _alternatives(_parser.parse(pattern.pattern, pattern.flags))]
    if [] in out:
        raise ValueError(f"no literal is in every match of {pattern.pattern[:60]}")
    return out


class Gate:
    """Tells by one scan, as bits, which patterns a text may have a match of.

    ``patterns``: for each, its alternatives as sets of literals (see ``literals``).
    """

    def __init__(self, patterns: Iterable[list[list[set[str]]]]):
        import ahocorasick

        sets: dict[frozenset[str], int] = {}
        self.needs = [(sum(sets.setdefault(frozenset(f), 1 << len(sets)) for f in {frozenset(f) for f in alternative}), 1 << i) for i, p in enumerate(patterns) for alternative in p]
        self.all = sum({b for _, b in self.needs})
        bits: dict[str, int] = {}
        for own, bit in sets.items():
            for x in own:
                bits[x] = bits.get(x, 0) | bit
        self.automaton = ahocorasick.Automaton()
        for x, b in bits.items():
            self.automaton.add_word(x, b)
        self.automaton.make_automaton()
        # characters that match one of the literals' without being its other case, such as a long s
        chars = "".join({c for x in bits for c in x})
        same = re.findall(f"[{re.escape(chars)}]", "".join(map(chr, range(128, sys.maxunicode + 1))), re.I)
        odd = "".join(c for c in same if c.lower() not in chars or len(c.lower()) > 1)
        self.odd = re.compile(f"[{re.escape(odd)}]") if odd else None
        self.known: dict[int, int] = {0: 0}

    def __call__(self, text: str) -> int:
        if self.odd and not text.isascii() and self.odd.search(text):
            return self.all
        has = 0
        for _, b in self.automaton.iter(text.lower()):
            has |= b
        if has not in self.known:
            if len(self.known) > 50_000:
                self.known = {0: 0}
            self.known[has] = 0
            for need, bit in self.needs:
                if has & need == need:
                    self.known[has] |= bit
        return self.known[has]
