"""Byte-pair encoding by speculation: propose longest matches, test all adjacent pairs.

A sequence of tokens is the encoding of a word exactly when every two neighbours, merged
on their own, stay these two tokens. So the longest token that fits is taken again and
again, which needs no merge ranks, all neighbours of all words are tested at once, and
only a word with a pair that fails is merged step by step.

Whether a pair stays is read off the merges that built its tokens. The right edge of the
left token and the left edge of the right one grow in the order of merge ranks; the pair
breaks if a merge across the edge is due before both edges have grown on.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
from tokenizers import Tokenizer

_NEVER = np.iinfo(np.int32).max
# The last symbol of a word, where the vocabulary marks word ends, is its letter moved up.
_FINAL = 0x1000
_GAP = "\x00"
# Pairs whose test is remembered; with so many more the memory starts anew.
_PAIRS = 1 << 21
# Up to this length the lowest pair is searched, beyond it is kept in a heap.
_SHORT = 48


class Pairs:
    """Vocabulary and merges of a byte-level BPE tokenizer, given as the path of its file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback")
        if model["type"] != "BPE" or odd or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("only a plain byte-level BPE model is supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        self.left = np.full(self.size, -1, np.int32)
        self.right = np.full(self.size, -1, np.int32)
        self.born = np.full(self.size, -1, np.int32)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        made = set()
        self.proper = True
        for rank, (a, b) in enumerate(merges):
            l, r, t = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.ranks.setdefault((l, r), (rank, t))
            # A token must be made once, after its parts, for the edges to tell the order.
            self.proper &= t not in made and self.born[l] < rank and self.born[r] < rank
            made.add(t)
            self.left[t], self.right[t], self.born[t] = l, r, rank
        pairs = np.array([l * self.size + r for l, r in self.ranks], np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.pair_ranks = np.array([rank for rank, _ in self.ranks.values()], np.int32)[order]
        self.made = np.zeros(len(merges), np.int64)
        for rank, token in self.ranks.values():
            self.made[rank] = token
        self.symbol_ids = np.zeros(2 * _FINAL, np.int64)
        for token, number in vocabulary.items():
            if len(form := self.symbol(token)) == 1:
                self.symbol_ids[ord(form)] = number
        self._edges()
        self.tested = np.zeros(0, np.int64)
        self.stays = np.zeros(0, bool)
        self.automaton = ahocorasick.Automaton()
        self.automaton.add_word(_GAP, 1)
        usable = self._reachable()
        for text, token in vocabulary.items():
            form = self.symbol(text)
            if form and (len(form) == 1 or usable[token]):
                self.automaton.add_word(form, (token + 1) << 16 | len(form))
        self.automaton.make_automaton()

    def symbol(self, token: str) -> str:
        """A token over one alphabet: the last letter of a word is moved up."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _FINAL)
        return token

    def word(self, piece: str) -> str:
        """A word of byte-level letters over that alphabet."""
        return piece[:-1] + chr(ord(piece[-1]) + _FINAL) if self.suffix else piece

    def _edges(self) -> None:
        """Of each token: what stands at its edges, from the letter up, and when it is merged on."""
        self.edges = []
        for child in (self.left, self.right):
            chains, at = [np.arange(self.size, dtype=np.int32)], np.arange(self.size)
            while True:
                below = child[at]
                at = np.where(below < 0, at, below)
                if (at == chains[-1]).all():
                    break
                chains.append(at.astype(np.int32))
            depth = len(chains)
            grown = np.stack(chains[::-1], axis=1)  # letters first, the token itself last
            # A letter is repeated at the front of a short chain; all but its last one are skipped.
            start = (grown[:, 1:] == grown[:, :1]).sum(axis=1) if depth > 1 else np.zeros(self.size, np.int64)
            due = np.full(grown.shape, _NEVER, np.int32)
            due[:, :-1] = self.born[grown[:, 1:]]
            self.edges.append((grown, due, start))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair is merged across its edge before the tokens are whole.

        -1 where that happens earlier, _NEVER where not at all.
        """
        (lefts, left_due, left_start), (rights, right_due, right_start) = self.edges
        found = np.full(len(a), _NEVER, np.int32)
        i, j = right_start[a].copy(), left_start[b].copy()
        going = np.arange(len(a))
        while len(going):
            p, q = a[going], b[going]
            x, y = rights[p, i[going]], lefts[q, j[going]]
            x_due, y_due = right_due[p, i[going]], left_due[q, j[going]]
            across = self._rank(x, y)
            # Of equal merges the one further left comes first.
            due = (across < x_due) & (across <= y_due) & (across != _NEVER)
            whole = (x_due == _NEVER) & (y_due == _NEVER)
            found[going[due]] = np.where(whole[due], across[due], -1)
            on = ~due & ~whole
            step_left = x_due <= y_due
            i[going[on & step_left]] += 1
            j[going[on & ~step_left]] += 1
            going = going[on]
        return found

    def _reachable(self) -> np.ndarray:
        """Tokens that merging their own letters gives."""
        usable = self.born < 0
        made = np.flatnonzero(self.born >= 0)
        whole = np.zeros(self.size, bool)
        whole[made] = self._apart(self.left[made], self.right[made]) == self.born[made]
        for token in made[np.argsort(self.born[made])]:
            usable[token] = whole[token] and usable[self.left[token]] and usable[self.right[token]]
        return usable

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two neighbours stay these two tokens."""
        keys, back = np.unique(a.astype(np.int64) * self.size + b, return_inverse=True)
        at = np.searchsorted(self.tested, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.tested)
        known[inside] = self.tested[at[inside]] == keys[inside]
        good = np.zeros(len(keys), bool)
        good[known] = self.stays[at[known]]
        new = keys[~known]
        if len(new):
            good[~known] = self._apart(new // self.size, new % self.size) == _NEVER
            if len(self.tested) > _PAIRS:
                self.tested, self.stays = self.tested[:0], self.stays[:0]
                at = np.zeros(len(keys), np.int64)
            self.stays = np.insert(self.stays, at[~known], good[~known])
            self.tested = np.insert(self.tested, at[~known], new)
        return good[back]

    def merge(self, words: list[str]) -> list[bytes]:
        """Words merged step by step: the lowest rank first, of equal ones the leftmost.

        All short words take a step at a time together.
        """
        out = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= _SHORT]
        for k, w in enumerate(words):
            if len(w) > _SHORT:
                out[k] = self._merge_long(w)
        if not short:
            return out
        lengths = np.array([len(words[k]) for k in short])
        tokens = self.symbol_ids[np.frombuffer("".join(words[k] for k in short).encode("utf-32-le"), "<u4")]
        of = np.repeat(np.arange(len(short)), lengths)
        ranks = self._neighbour_ranks(tokens, of, np.arange(len(tokens)))
        while len(tokens):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            least = np.minimum.reduceat(ranks, starts)
            done = least == _NEVER
            if done.any():
                ends = np.append(starts[1:], len(tokens))
                raw = tokens.astype("<u4").tobytes()
                for k, s, e in zip(of[starts[done]].tolist(), (4 * starts[done]).tolist(), (4 * ends[done]).tolist()):
                    out[short[k]] = raw[s:e]
                left = np.repeat(~done, ends - starts)
                tokens, of, ranks, least = tokens[left], of[left], ranks[left], least[~done]
                if not len(tokens):
                    break
                starts = np.flatnonzero(np.diff(of, prepend=-1))
            sizes = np.diff(np.append(starts, len(tokens)))
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = at[np.diff(of[at], prepend=-1) > 0]
            tokens[at] = self.made[ranks[at]]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, of, ranks = tokens[keep], of[keep], ranks[keep]
            at -= np.arange(len(at))
            near = np.concatenate([at, at[at > 0] - 1])
            ranks[near] = self._neighbour_ranks(tokens, of, near)
        return out

    def _neighbour_ranks(self, tokens: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of each token with the next one of the same word."""
        follow = np.minimum(at + 1, len(tokens) - 1)
        return np.where((of[follow] == of[at]) & (follow > at), self._rank(tokens[at], tokens[follow]), _NEVER)

    def _merge_long(self, word: str) -> bytes:
        tokens = self.symbol_ids[np.frombuffer(word.encode("utf-32-le"), "<u4")].tolist()
        ranks, n = self.ranks, len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = enumerate(zip(tokens, tokens[1:]))
        heap = [(found[0], k, *pair, found[1]) for k, pair in pairs if (found := ranks.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y, made = heapq.heappop(heap)
            right = after[k]
            if right >= n or tokens[k] != x or tokens[right] != y:
                continue
            tokens[k], tokens[right] = made, -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if found := ranks.get((made, tokens[after[k]])):
                    heapq.heappush(heap, (found[0], k, made, tokens[after[k]], found[1]))
            if before[k] >= 0 and (found := ranks.get((tokens[before[k]], made))):
                heapq.heappush(heap, (found[0], before[k], tokens[before[k]], made, found[1]))
        return np.array([t for t in tokens if t >= 0], "<u4").tobytes()

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches of all words: tokens, where each word ends in them, which words they cover."""
        text = _GAP.join(words) + _GAP
        found = np.fromiter(map(itemgetter(1), self.automaton.iter_long(text)), np.int64)
        tokens, lengths = (found >> 16) - 1, found & 0xFFFF
        gaps = np.flatnonzero(tokens < 0)
        covered = np.add.reduceat(lengths, np.concatenate([[0], gaps[:-1] + 1])) - 1
        bounds = gaps - np.arange(len(gaps))
        return tokens[tokens >= 0], bounds, covered == np.array([len(w) for w in words])

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each (not empty) piece of byte-level letters, four bytes each, low ones first."""
        if not pieces:
            return []
        words = [self.word(p) for p in pieces]
        if not self.proper:
            return self.merge(words)
        tokens, bounds, good = self.propose(words)
        starts = np.concatenate([[0], bounds[:-1]])
        inner = np.ones(len(tokens), bool)
        inner[bounds[bounds > 0] - 1] = False  # the last token of a word has no neighbour
        at = np.flatnonzero(inner)
        if len(at):
            bad = at[~self.compatible(tokens[at], tokens[at + 1])]
            good[np.searchsorted(bounds, bad, side="right")] = False
        raw = tokens.astype("<u4").tobytes()
        out = [raw[s:e] for s, e in zip((4 * starts).tolist(), (4 * bounds).tolist())]
        failed = np.flatnonzero(~good).tolist()
        for k, merged in zip(failed, self.merge([words[k] for k in failed])):
            out[k] = merged
        return out


@lru_cache(maxsize=2)
def pairs_of(path: str) -> Pairs:
    return Pairs(path)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)
