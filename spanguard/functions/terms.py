"""Many literal terms at once: an Aho-Corasick automaton in flat arrays.

Texts are read from their end to their start over reversed terms, so that each place where a term begins is known with
the longest term there; taking these from the left gives the leftmost, longest matches in one pass, whatever the terms.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator, Mapping

#: Code points have less bits than this.
_BITS = 21


class Automaton:
    """Terms (empty ones left out, repeated ones once); nodes are numbers from 0, the root."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = list(dict.fromkeys(t for t in terms if t))
        self.edge: dict[int, int] = {}
        self.term = array("q", [-1])  # the term that a node spells, or -1
        depth = [0]
        for k, term in enumerate(self.terms):
            node = 0
            for c in reversed(term):
                key = node << _BITS | ord(c)
                node = self.edge.setdefault(key, len(depth))
                if node == len(depth):
                    depth.append(depth[key >> _BITS] + 1)
                    self.term.append(-1)
            self.term[node] = k
        self._link(depth)
        last = sorted({t[-1] for t in self.terms})
        self.any_last = re.compile("[" + "".join(map(re.escape, last)) + "]").search if last else None

    def _link(self, depth: list[int]) -> None:
        """fail: the node of the longest other ending; shorter: the nearest of those that is a term; longest: length of
        the longest term that is an ending of the node."""
        n = len(depth)
        self.fail, self.shorter, self.longest = array("q", [0] * n), array("q", [0] * n), array("q", [0] * n)
        for key, node in sorted(self.edge.items(), key=lambda e: depth[e[1]]):
            parent, code = key >> _BITS, key & (1 << _BITS) - 1
            if parent:
                k = self.fail[parent]
                while (to := self.edge.get(k << _BITS | code)) is None and k:
                    k = self.fail[k]
                self.fail[node] = to or 0
            f = self.fail[node]
            self.shorter[node] = f if self.term[f] >= 0 else self.shorter[f]
            self.longest[node] = depth[node] if self.term[node] >= 0 else self.longest[f]

    def begins(self, text: str) -> Iterator[tuple[int, int]]:
        """(place, node) of each place of the text where a term begins, from the last to the first."""
        if self.any_last is None:
            return
        back, n, edge, fail, longest, search = text[::-1], len(text), self.edge, self.fail, self.longest, self.any_last
        at = node = 0
        while at < n:
            if not node:
                found = search(back, at)
                if found is None:
                    return
                at = found.start()
            code = ord(back[at])
            while (to := edge.get(node << _BITS | code)) is None and node:
                node = fail[node]
            node = to or 0
            at += 1
            if longest[node]:
                yield n - at, node

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the leftmost, longest matches, without overlaps."""
        out, at = [], 0
        for start, node in reversed(list(self.begins(text))):
            if start >= at:
                at = start + self.longest[node]
                out.append((start, at))
        return out

    def contained(self, text: str) -> set[int]:
        """Numbers of the terms that occur anywhere in the text, also inside each other."""
        out: set[int] = set()
        seen: set[int] = set()
        for _, node in self.begins(text):
            while node and node not in seen:
                seen.add(node)
                if self.term[node] >= 0:
                    out.add(self.term[node])
                node = self.shorter[node]
        return out

    def resolve(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of all terms, longest first, then by text; one that overlaps a place taken before is left out.

        The places of one term are those that don't overlap each other from the left, taken or not.
        """
        places: dict[int, list[int]] = {}
        for start, node in self.begins(text):
            node = node if self.term[node] >= 0 else self.shorter[node]
            while node:
                places.setdefault(self.term[node], []).append(start)
                node = self.shorter[node]
        taken, out = bytearray(len(text)), []
        for k in sorted(places, key=lambda k: (-len(self.terms[k]), self.terms[k])):
            size, free = len(self.terms[k]), 0
            for start in reversed(places[k]):
                if start >= free:
                    free = start + size
                    if not (taken[start] or taken[free - 1]):  # a shorter term can't reach over a longer one
                        taken[start:free] = b"\1" * size
                        out.append((start, free))
        return sorted(out)

    def replace(self, text: str, values: Mapping[str, str]) -> tuple[str, bool]:
        """(text with each match replaced by its value, whether there was any)."""
        found = self.matches(text)
        if not found:
            return text, False
        out, at = [], 0
        for start, end in found:
            out += text[at:start], values[text[start:end]]
            at = end
        return "".join(out) + text[at:], True
