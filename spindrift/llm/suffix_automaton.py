"""Suffix automaton over a sequence of symbols, and what it tells of repetition."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """All substrings of ``symbols`` in O(n) states. The substrings of a state occur more than once if and only if the state is
    the suffix link of another; a symbol None equals no other."""

    def __init__(self, symbols: Sequence[Hashable | None]):
        follow: list[dict] = [{}]
        link, length = [-1], [0]
        self.prefix: list[int] = []  # state of each prefix
        last = 0
        for c in symbols:
            cur = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            if c is not None:
                p = last
                while p != -1 and c not in follow[p]:
                    follow[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = follow[p][c]
                    if length[p] + 1 == length[q]:
                        link[cur] = q
                    else:
                        clone = len(follow)
                        follow.append(follow[q].copy())
                        length.append(length[p] + 1)
                        link.append(link[q])
                        while p != -1 and follow[p].get(c) == q:
                            follow[p][c] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
            last = cur
            self.prefix.append(cur)
        self.link, self.length = link, length
        self.again = set(link)

    def covered(self, least: int = 2) -> list[bool]:
        """For each symbol whether it lies in a substring of at least ``least`` symbols that occurs more than once.

        At each end the longest repeated suffix is marked, which is that of the prefix's state or of its suffix link; every
        repeated maximal substring ends as such a suffix.
        """
        n = len(self.prefix)
        out, reach = [False] * n, n
        for i in range(n - 1, -1, -1):
            v = self.prefix[i]
            longest = self.length[v if v in self.again else self.link[v]]
            if longest >= least:
                reach = min(reach, i - longest + 1)
            out[i] = reach <= i
            if reach >= i:
                reach = n
        return out
