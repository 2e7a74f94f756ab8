"""A suffix automaton over any hashable symbols (Blumer et al.), built online."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """next[s]: symbol -> state; link[s]: suffix link; longest[s]: length of the longest string of state s; ends[s]: one end position."""

    def __init__(self):
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.longest, self.first_end = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def _state(self, nxt: dict, link: int, longest: int, end: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.longest.append(longest)
        self.first_end.append(end)
        return len(self.link) - 1

    def extend(self, symbols: Iterable[Hashable]) -> SuffixAutomaton:
        for c in symbols:
            new = self._state({}, 0, self.longest[self.last] + 1, self.size)
            p = self.last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.longest[q] == self.longest[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(dict(self.next[q]), self.link[q], self.longest[p] + 1, self.first_end[q])
                    self.link[q] = self.link[new] = twin
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
            self.last = new
            self.size += 1
        return self

    def longest_prefix(self, symbols, start: int = 0) -> int:
        """Length of the longest factor of the indexed text that symbols[start:] begins with."""
        state, i, n, nxt = 0, start, len(symbols), self.next
        while i < n and (to := nxt[state].get(symbols[i])) is not None:
            state = to
            i += 1
        return i - start

    def phrases(self, symbols) -> int:
        """Phrases of the greedy cross-parse: each is the longest factor found, or one unseen symbol."""
        i, n, count = 0, len(symbols), 0
        while i < n:
            i += max(1, self.longest_prefix(symbols, i))
            count += 1
        return count

    def matching(self, symbols) -> list[tuple[int, int]]:
        """Matching statistics: for each position the length of the longest factor that ends there, and its state."""
        state, length, out = 0, 0, []
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if (to := self.next[state].get(c)) is not None:
                state, length = to, length + 1
            else:
                state, length = 0, 0
            out.append((length, state))
        return out
