"""Restoring originals in text that comes in pieces: an incremental tokenizer over a conversation's lookups."""

from __future__ import annotations

import re
from collections.abc import Mapping

_OPEN, CLOSE = "<pii", "</pii>"
_ID = re.compile(r'^<pii[^>]*\bid="([^"]*)"')
_INNER = re.compile(r"(?s)^[^>]*>(.*)</")
#: Code points have less bits than this.
_BITS = 21


class Known:
    """A conversation's lookups, and a tree of its surrogates and of the opening of tokens."""

    def __init__(self, by_id: Mapping[str, str], by_display: Mapping[str, str], by_synthetic: Mapping[str, str]):
        self.by_id, self.by_display = by_id, by_display
        self.by_synthetic = {k: v for k, v in by_synthetic.items() if k}
        self.edge: dict[int, int] = {}
        self.whole, self.inner = [False], [False]  # of each node: whether it is a term, and whether one goes on from it
        for term in (*self.by_synthetic, _OPEN):
            node = 0
            for c in term:
                self.inner[node] = True
                key = node << _BITS | ord(c)
                node = self.edge.setdefault(key, len(self.whole))
                if node == len(self.whole):
                    self.whole.append(False)
                    self.inner.append(False)
            self.whole[node] = True
        firsts = sorted({t[0] for t in (*self.by_synthetic, _OPEN)})
        self.first = re.compile("[" + "".join(map(re.escape, firsts)) + "]").search

    def token(self, token: str) -> str:
        """A whole token by its id, then by what it shows; one without an id, or that isn't known, stays."""
        tid, shown = _ID.search(token), _INNER.search(token)
        if not tid or not tid[1]:
            return token
        if tid[1] in self.by_id:
            return self.by_id[tid[1]]
        return self.by_display.get(shown[1] if shown else "", token)


class Restorer:
    """Turns deltas of one response into restored text; the same text comes out however the deltas are cut.

    Between tokens it holds back an end of the text that may still become a (longer) surrogate, which is replaced
    where it is leftmost and longest; `held` is never longer than the longest one. In a token, which ends where it is
    closed, it holds back what came as `pieces`, and reads each character once: phase 1 before the opening's end, 2
    behind it, where `held` is the end of what was read, in which the closing may have begun.
    """

    def __init__(self, known: Known, held: str = "", phase: int = 0, pieces: list[str] | None = None):
        self.known, self.held, self.phase, self.pieces = known, held, phase, pieces if pieces is not None else []

    def feed(self, delta: str) -> str:
        out: list[str] = []
        rest = self._in_token(delta, out) if self.phase else delta
        while not self.phase:
            rest = self._in_text(rest, out, False)
            if not self.phase:
                break
            rest = self._in_token(rest, out)
        return "".join(out)

    def finish(self) -> str:
        """What is still held: a token that wasn't closed is text."""
        out: list[str] = []
        if self.phase:
            self.held, self.phase, self.pieces = "".join(self.pieces), 0, []
        self._in_text("", out, True)
        return "".join(out)

    def _in_text(self, new: str, out: list[str], final: bool) -> str:
        """Restore text up to the opening of a token; returns what follows that."""
        known, raw = self.known, self.held + new
        edge, whole, i, n = known.edge, known.whole, 0, len(raw)
        self.held = ""
        while i < n:
            found = known.first(raw, i)
            if found is None:
                out.append(raw[i:])
                return ""
            out.append(raw[i : found.start()])
            i = j = found.start()
            node, best = 0, 0
            while j < n and (to := edge.get(node << _BITS | ord(raw[j]))) is not None:
                node, j = to, j + 1
                if whole[node]:
                    if not final and j - i == len(_OPEN) and raw.startswith(_OPEN, i):
                        self.phase, self.pieces = 1, [_OPEN]
                        return raw[j:]
                    if j - i != len(_OPEN) or raw[i:j] in known.by_synthetic:
                        best = j
            if j == n and known.inner[node] and not final:
                self.held = raw[i:]
                return ""
            out.append(known.by_synthetic[raw[i:best]] if best else raw[i])
            i = best or i + 1
        return ""

    def _in_token(self, new: str, out: list[str]) -> str:
        """Read on in an open token; returns what follows its end."""
        at = 0
        if self.phase == 1:
            at = new.find(">") + 1
            if not at:
                self.pieces.append(new)
                return ""
            self.phase, self.held = 2, ""
        seen = self.held + new[at:]
        end = seen.find(CLOSE)
        if end < 0:
            self.held = seen[-len(CLOSE) + 1 :]
            self.pieces.append(new)
            return ""
        stop = at + end + len(CLOSE) - len(self.held)
        out.append(self.known.token("".join(self.pieces) + new[:stop]))
        self.held, self.phase, self.pieces = "", 0, []
        return new[stop:]


def restore_text(text: str, known: Known) -> str:
    restorer = Restorer(known)
    return restorer.feed(text) + restorer.finish()
