"""Byte-pair merges with the two linear-time views on them that the token operators need.

A token sequence is the one that merging yields exactly when every token merges to itself and every two
neighbours, merged again from their symbols, stay the same two tokens.  ``Merges.fits`` is that check; results of
it are remembered.  ``encode`` finds the sequence by backtracking over longest matches, ``prefixes`` by a table
over all prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import ahocorasick

Rank = Callable[[str, str], "float | None"]


class Merges:
    def __init__(self, tokens: Sequence[str], rank: Rank, remember: int = 600_000) -> None:
        """tokens: all that may come out, as strings of symbols; rank: of a merge of two neighbours, lowest first, None if there is none."""
        self.rank, self.remember = rank, remember
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.words = list(tokens)
        self.sizes = [len(t) for t in tokens]
        self.known: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.machine = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.machine.add_word(t, i)
        self.machine.make_automaton()
        self._shorter: dict[int, int] = {}
        self._last: dict[int, tuple[float, int, int]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: lowest rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, token: int) -> tuple[float, int, int]:
        """Rank and parts of the merge that makes the token; rank -1 for a single symbol."""
        known = self._last.get(token)
        if known is None:
            word = self.words[token]
            parts, rank = list(word), -1.0
            while len(parts) > 2:
                ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
                if not ranks:
                    break
                at = min(ranks)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and (r := self.rank(*parts)) is not None:
                rank = r
            known = self._last[token] = (rank, self.ids[parts[0]], self.ids[parts[-1]]) if rank >= 0 else (-1.0, token, token)
        return known

    def itself(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.words[token]) == [self.words[token]]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two stay apart and whole when their symbols are merged again.

        The merges of both are taken back from the last to the first.  If at some point the parts that touch would
        have merged before the merge just taken back (or at its rank and further left), they don't stay apart.
        """
        key = left << 20 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            known = self.known[key] = self.itself(left) and self.itself(right) and self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        words, rank, last, none = self.words, self.rank, self.last_merge, -1.0
        limit, ties = float("inf"), True
        while True:
            across = rank(words[left], words[right])
            if across is not None and (across < limit or ties and across == limit):
                return False
            of_left, of_right = last(left), last(right)
            if of_left[0] > of_right[0]:
                limit, ties, left = of_left[0], False, of_left[2]
            elif of_right[0] != none:
                limit, ties, right = of_right[0], True, of_right[1]
            else:
                return True

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1: none."""
        found = self._shorter.get(token)
        if found is None:
            word = self.words[token]
            found = self._shorter[token] = next((self.ids[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.ids), -1)
        return found

    def longest(self, text: str) -> list[int]:
        """The longest token that starts at each position, from one pass of the automaton; -1: none."""
        out, sizes = [-1] * len(text), self.sizes
        for end, token in self.machine.iter(text):  # by end, so what comes later at a start is longer
            out[end + 1 - sizes[token]] = token
        return out

    def encode(self, text: str) -> list[int]:
        """Tokens of ``text``, whose every symbol must be a token, by backtracking over longest matches."""
        size, sizes, known = len(text), self.sizes, self.known
        if not size:
            return []
        first = self.longest(text)
        failed = 0  # bit field: positions from which the end can't be reached
        tokens: list[int] = []
        at, token, last = 0, first[0], -1
        while at < size:
            end = at + sizes[token]
            if not failed >> end & 1:
                if last < 0:
                    fit = self.itself(token)
                else:
                    fit = known.get(last << 20 | token)
                    if fit is None:
                        fit = self.fits(last, token)
                if fit:
                    tokens.append(token)
                    at, last = end, token
                    if at < size:
                        token = first[at]
                    continue
            token = self.shorter(token)
            if token >= 0:
                continue
            failed |= 1 << at
            if not tokens:
                raise ValueError("no sequence of tokens")
            token = tokens.pop()
            last = tokens[-1] if tokens else -1
            at -= sizes[token]
        return tokens

    def prefixes(self, text: str) -> list[int]:
        """Number of tokens of every prefix: entry i is for the first i symbols."""
        size, sizes, known = len(text), self.sizes, self.known
        count, last = [0] * (size + 1), [-1] * (size + 1)
        done = 0
        for end, token in self.machine.iter(text):
            i = end + 1
            if i == done:  # the token of this prefix is known; others that end here cannot fit too
                continue
            j = i - sizes[token]
            if j:
                fit = known.get(last[j] << 20 | token)
                if fit is None:
                    fit = self.fits(last[j], token)
            else:
                fit = self.itself(token)
            if fit:
                last[i], count[i] = token, count[j] + 1
                done = i
        if size and 0 in count[1:]:
            raise ValueError("no sequence of tokens")
        return count
