"""Target words and phrases as a trie over tokens with failure links.

A text is walked once, whatever the number and length of the targets: each token
moves one step in the trie, or along failure links to the longest suffix that is
still a prefix of a target. Of the targets that begin at a token the first in
order counts; matches are then kept from left to right without overlaps.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable
from itertools import compress, repeat

from driftlex.functions.text import PUNCTUATION

TOKEN = re.compile(r"\S+")
LETTERS = re.compile("[a-zA-Z'’-]+")

Match = tuple[int, int, str]


def stripped(tokens: list[str]) -> Iterable[str]:
    """Keys of tokens: outer ASCII punctuation off, lower case."""
    return map(str.lower, map(str.strip, tokens, repeat(PUNCTUATION)))


def lowered(tokens: list[str]) -> Iterable[str]:
    return map(str.lower, tokens)


class Matcher:
    """Targets in order; with ``phrases_first`` those of several words come before single ones."""

    def __init__(self, targets: list[str], phrases_first: bool = False, key: Callable[[list[str]], Iterable[str]] = stripped):
        order = sorted(enumerate(targets), key=lambda t: (" " not in t[1], t[0])) if phrases_first else enumerate(targets)
        known: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        # of each node: rank, words and text of the target that ends there
        ends: list[tuple[int, int, str] | None] = [None]
        for rank, (_, target) in enumerate(order):
            node, words = 0, target.split(" ")
            for w in words:
                n = known.setdefault(w, len(known) + 1)
                if n not in self.next[node]:
                    self.next[node][n] = len(self.next)
                    self.next.append({})
                    ends.append(None)
                node = self.next[node][n]
            if ends[node] is None:
                ends[node] = rank, len(words), target
        self.fail = [0] * len(self.next)
        self.found: list[list[tuple[int, int, str]]] = [[e] if e else [] for e in ends]
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for n, child in self.next[node].items():
                queue.append(child)
                back = self.fail[node]
                while back and n not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(n, 0)
                self.found[child] = self.found[child] + self.found[self.fail[child]]
        self.known, self.key = known, key
        # without phrases a token is a match by itself
        self.singles = {known[e[2]]: e[2] for e in ends if e} if all(e is None or e[1] == 1 for e in ends) else None

    def matches(self, tokens: list[str]) -> list[Match]:
        """(first token, words, target) of the matches that are kept, from left to right."""
        numbers = list(map(self.known.get, self.key(tokens)))
        places = compress(range(len(numbers)), numbers)
        if self.singles is not None:
            return [(i, 1, self.singles[numbers[i]]) for i in places]
        best: dict[int, tuple[int, int, str]] = {}
        node, last = 0, -1
        for i in places:
            if i != last + 1:
                node = 0
            last, n = i, numbers[i]
            while node and n not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(n, 0)
            for hit in self.found[node]:
                at = i - hit[1] + 1
                if at not in best or hit < best[at]:
                    best[at] = hit
        out, free = [], 0
        for at in sorted(best):
            if at >= free:
                _, words, target = best[at]
                out.append((at, words, target))
                free = at + words
        return out
