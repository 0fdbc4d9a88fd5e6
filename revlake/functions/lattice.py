"""Cutting texts into dictionary words, many texts at a time.

A dictionary is a ``Trie``: the hashes of all beginnings of its terms, sorted, with the cost of those that are terms.
All positions of a batch are looked up together, one more character each time, and only those go on whose text
so far begins a term. So what is found are true hits, whatever the number of terms.

Two cuts use them. ``longest`` takes the longest term at each position, else a Han character, a run of letters
and digits, or a mark. ``cheapest`` takes the path of least total cost through the lattice of all terms inside a
run of Han characters (or of letters and digits too), where an unknown character costs ``unknown``;
stretches of single characters may then be cut by tags, see ``Tags``. Costs are whole numbers, so
that paths compare exactly; of equal paths the one with the longer first word counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

SPACE, HAN, RUN, MARK = range(4)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEVER = 1 << 60
#: Runs whose words are kept between calls, and the characters of one at most.
KNOWN_RUNS, KNOWN_CHARS = 200_000, 40
_HAN, _RUN = regex.compile(r"\p{Script=Han}"), regex.compile(r"[\p{L}\p{N}]")


@lru_cache(maxsize=None)
def _kind(code: int) -> int:
    char = chr(code)
    if char.isspace() or 0x1C <= code <= 0x1F:
        return SPACE
    return HAN if _HAN.match(char) else RUN if _RUN.match(char) else MARK


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins (and the last ends)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of texts from those of their beginnings, one character shorter."""
    h = (h + codes.astype(np.uint64) + np.uint64(1)) * _STEP
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Trie:
    hashes: np.ndarray  # of all beginnings, sorted
    costs: np.ndarray  # of terms, -1 for mere beginnings
    longest: int

    @classmethod
    def build(cls, terms: list[str], costs: list[int]) -> Trie:
        pairs = [(t, c) for t, c in zip(terms, costs) if t]
        codes, starts = _codes([t for t, _ in pairs])
        size = np.diff(starts)
        own = np.array([c for _, c in pairs], np.int64)
        alive, h, found, cost = np.arange(len(pairs)), np.zeros(len(pairs), np.uint64), [], []
        longest = int(size.max(initial=0))
        for k in range(longest):
            h = _longer(h, codes[starts[alive] + k])
            found.append(h)
            cost.append(np.where(size[alive] == k + 1, own[alive], -1))
            on = size[alive] > k + 1
            alive, h = alive[on], h[on]
        if not found:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
        every, price = np.concatenate(found), np.concatenate(cost)
        order = np.lexsort((np.where(price < 0, _NEVER, price), every))  # the cheapest of equal terms, then beginnings
        every, price = every[order], price[order]
        first = np.concatenate([[True], every[1:] != every[:-1]])
        return cls(every[first], price[first], longest)

    def hits(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, cost) of all terms in ``codes`` that end before the ``ends`` of their positions, by length."""
        at, size, cost = [], [], []
        alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for k in range(1, self.longest + 1 if len(self.hashes) else 0):
            on = alive + k <= ends[alive]
            alive = alive[on]
            if not len(alive):
                break
            h = _longer(h[on], codes[alive + k - 1])
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            on = self.hashes[place] == h
            alive, h, place = alive[on], h[on], place[on]
            term = self.costs[place] >= 0
            at.append(alive[term])
            size.append(np.full(term.sum(), k))
            cost.append(self.costs[place[term]])
        if not at:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(at), np.concatenate(size), np.concatenate(cost)


@dataclass(frozen=True)
class Tags:
    """Costs of a hidden Markov model with the tags begin, middle, end and single.

    ``start`` and ``after[i][j]`` are costs of tags, ``chars`` those of a character under each tag.
    """

    start: tuple[int, ...]
    after: tuple[tuple[int, ...], ...]
    chars: dict[str, tuple[int, ...]]
    unseen: tuple[int, ...]

    def cut(self, text: str) -> list[str]:
        """The words of the cheapest tags; of equally cheap ones the tag that comes first, from the end."""
        own = self.chars.get(text[0], self.unseen)
        cost = [s + c for s, c in zip(self.start, own)]
        back = []
        for char in text[1:]:
            own = self.chars.get(char, self.unseen)
            best = [min((cost[i] + self.after[i][j], i) for i in range(4)) for j in range(4)]
            back.append([i for _, i in best])
            cost = [b + c for (b, _), c in zip(best, own)]
        tag = min((cost[j], j) for j in (2, 3))[1]
        words, end = [], len(text)
        for at in range(len(text) - 1, -1, -1):
            if tag in (0, 3):
                words.append(text[at:end])
                end = at
            if at:
                tag = back[at - 1][tag]
        return words[::-1]


def _blocks(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each position, and the end of its run of one kind inside its text."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds, back = np.unique(codes, return_inverse=True)
    kind = np.array([_kind(int(c)) for c in kinds], np.int64)[back]
    new = np.ones(len(codes), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts[:-1][starts[:-1] < len(codes)]] = True
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(codes))
    return kind, np.repeat(ends, ends - first)


def longest(texts: list[str], trie: Trie) -> list[list[str]]:
    """Longest term first; terms may hold any characters."""
    codes, starts = _codes(texts)
    kind, run_end = _blocks(codes, starts)
    at, size, _ = trie.hits(codes, np.repeat(starts[1:], np.diff(starts)))
    best = np.zeros(len(codes), np.int64)
    best[at] = size  # by length, so the longest stays
    length = np.where(best > 0, best, np.where(kind == RUN, run_end - np.arange(len(codes)), np.where(kind == SPACE, 0, 1))).tolist()
    out = []
    for text, base in zip(texts, starts.tolist()):
        i, tokens = 0, []
        while i < len(text):
            k = length[base + i]
            if k:
                tokens.append(text[i : i + k])
            i += k or 1
        out.append(tokens)
    return out


def _edges(codes: np.ndarray, kind: np.ndarray, run_end: np.ndarray, trie: Trie, letters: bool) -> dict[int, list]:
    """Terms by position, inside runs only."""
    inside = (kind == HAN) | ((kind == RUN) & letters)
    out: dict[int, list] = {}
    for at, size, cost in zip(*(x.tolist() for x in trie.hits(codes, np.where(inside, run_end, np.arange(len(codes)))))):
        out.setdefault(at, []).append((size, cost))
    return out


def _cheapest_run(edges: dict[int, list], lo: int, hi: int, unknown: int) -> list[int]:
    """Word lengths of the cheapest path from ``lo`` to ``hi``."""
    cost, step = [0] * (hi - lo + 1), [1] * (hi - lo)
    for at in range(hi - 1, lo - 1, -1):
        here = edges.get(at, ())
        paths = [(c + cost[at + k - lo], -k) for k, c in here]
        if not here or here[0][0] != 1:
            paths.append((unknown + cost[at + 1 - lo], -1))
        best = min(paths)
        cost[at - lo], step[at - lo] = best[0], -best[1]
    sizes, at = [], 0
    while at < hi - lo:
        sizes.append(step[at])
        at += step[at]
    return sizes


def _with_tags(words: list[str], tags: Tags) -> list[str]:
    """Stretches of two single characters or more, cut by their tags."""
    out, held = [], ""
    for word in [*words, None]:
        if word is not None and len(word) == 1:
            held += word
            continue
        if held:
            out += tags.cut(held) if len(held) > 1 else [held]
            held = ""
        if word is not None:
            out.append(word)
    return out


def _cut_runs(runs: list[str], trie: Trie, unknown: int, letters: bool, tags: Tags | None) -> Iterator[tuple[str, list[str]]]:
    """Runs of one kind with their words."""
    codes, starts = _codes(runs)
    kind, run_end = _blocks(codes, starts)
    edges = _edges(codes, kind, run_end, trie, letters)
    for run, base in zip(runs, starts.tolist()):
        words, i = [], 0
        for k in _cheapest_run(edges, base, base + len(run), unknown):
            words.append(run[i : i + k])
            i += k
        yield run, _with_tags(words, tags) if tags else words


def cheapest(
    texts: list[str], trie: Trie, unknown: int, letters: bool = False, tags: Tags | None = None, known: dict[str, list[str]] | None = None,
) -> list[list[str]]:
    """The words of each text. A run is cut alike wherever it stands, so equal ones are cut once; ``known`` keeps them from call to call."""
    codes, starts = _codes(texts)
    kind, _ = _blocks(codes, starts)
    first = np.ones(len(codes), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[starts[:-1][starts[:-1] < len(codes)]] = True
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], len(codes)).tolist()
    kinds, whole = kind[begins], "".join(texts)
    parts = [whole[a:b] for a, b in zip(begins.tolist(), ends)]
    cut = ((kinds == HAN) | ((kinds == RUN) & letters)).tolist()
    known = {} if known is None else known
    if len(known) > KNOWN_RUNS:
        known.clear()
    new = [p for p in dict.fromkeys(p for p, c in zip(parts, cut) if c) if p not in known]
    found = dict(_cut_runs(new, trie, unknown, letters, tags))
    known.update((run, words) for run, words in found.items() if len(run) <= KNOWN_CHARS)
    at = np.searchsorted(begins, starts).tolist()
    kinds, out = kinds.tolist(), []
    for lo, hi in zip(at, at[1:]):
        tokens = []
        for part, k, c in zip(parts[lo:hi], kinds[lo:hi], cut[lo:hi]):
            if c:
                tokens += found[part] if part in found else known[part]
            elif k == RUN:
                tokens.append(part)
            elif k == MARK:
                tokens += part
        out.append(tokens)
    return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expected_counts(runs: list[str], times: list[int], trie: Trie, unknown: int, scale: int) -> dict[str, float]:
    """How often each term is met on all paths through the given runs, paths weighted by exp(-cost / scale)."""
    codes, starts = _codes(runs)
    ends = np.repeat(starts[1:], np.diff(starts))
    edges: dict[int, list] = {}
    for at, size, cost in zip(*(x.tolist() for x in trie.hits(codes, ends))):
        edges.setdefault(at, []).append((size, -cost / scale, True))
    out: dict[str, float] = {}
    for run, n, base in zip(runs, times, starts.tolist()):
        here = [edges.get(base + i, []) for i in range(len(run))]
        here = [e if e and e[0][0] == 1 else [*e, (1, -unknown / scale, False)] for e in here]
        ahead = [0.0] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            ahead[i] = _log_sum([w + ahead[i + k] for k, w, _ in here[i]])
        reach: list[list[float]] = [[0.0]] + [[] for _ in run]
        for i, steps in enumerate(here):
            if not reach[i]:
                continue
            so_far = _log_sum(reach[i])
            for k, w, known in steps:
                reach[i + k].append(so_far + w)
                if known:
                    term = run[i : i + k]
                    out[term] = out.get(term, 0.0) + n * math.exp(so_far + w + ahead[i + k] - ahead[0])
    return out
