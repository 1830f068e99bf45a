"""Ids of many short words of a byte-pair model at once, in arrays."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.iinfo(np.int32).max  # the rank of a pair that isn't merged
_BITS = 18


class BytePairs:
    """In each round every word merges its pair of the lowest rank, the leftmost of equal ones, as the
    tokenizer's own model does for one word; words without such a pair are done."""

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.first = np.array([vocab[letters[b]] if b != 10 else 0 for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + end] if b != 10 else 0 for b in range(256)], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        if len(np.unique(self.made)) < len(keys) or len(keys) > 1 << _BITS - 1 or max(vocab.values()) >> 20:
            raise ValueError("not a model of this kind")
        self.keys, self.ranks = np.full(1 << _BITS, -1, dtype=np.int64), np.zeros(1 << _BITS, dtype=np.int32)
        slot, rank = self._slots(keys), np.arange(len(keys), dtype=np.int32)
        while len(rank):  # open addressing: what finds its slot taken goes on to the next
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[rank[free]]
            placed = self.keys[slot] == keys[rank]
            self.ranks[slot[placed]] = rank[placed]
            slot, rank = (slot[~placed] + 1) & (1 << _BITS) - 1, rank[~placed]

    @classmethod
    def of(cls, tokenizer, letters: dict[int, str]) -> BytePairs | None:
        """None if the tokenizer's model is of another kind."""
        model = json.loads(tokenizer.to_str())["model"]
        other = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        try:
            return None if model["type"] != "BPE" or any(model.get(x) for x in other) else cls(model, letters)
        except (KeyError, ValueError):
            return None

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        slot, at, ranks = self._slots(key), np.arange(len(key)), np.full(len(key), _NONE, dtype=np.int32)
        while len(at):
            there = self.keys[slot]
            same = there == key
            ranks[at[same]] = self.ranks[slot[same]]
            on = ~same & (there >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & (1 << _BITS) - 1
        return ranks

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, none of them empty or with a line feed, and how many each has."""
        raw = np.frombuffer("\n".join([*words, ""]).encode(), dtype=np.uint8)
        letter = raw != 10
        word = (np.cumsum(~letter, dtype=np.int32))[letter]
        last = np.flatnonzero(~letter) - 1 - np.arange(len(words))
        raw = raw[letter]
        ids = self.first[raw]
        ids[last] = self.last[raw[last]]
        rank = np.append(self._ranks(ids[:-1], ids[1:]), np.int32(_NONE))
        rank[last] = _NONE
        done = []
        while True:
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(word)))
            ready = least == _NONE
            done.append((ids[ready], word[ready]))
            ids, word, rank, least = (x[~ready] for x in (ids, word, rank, least))
            if not len(ids):
                break
            at = np.flatnonzero(rank == least)
            at = at[np.diff(word[at], prepend=-1) != 0]
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            ids, word, rank = ids[stay], word[stay], rank[stay]
            at -= np.arange(len(at))  # one is gone for each merge before
            rank[at] = _NONE
            anew = np.concatenate([at, at - 1])
            anew = anew[(anew >= 0) & (anew < len(ids) - 1)]
            anew = anew[word[anew] == word[anew + 1]]
            rank[anew] = self._ranks(ids[anew], ids[anew + 1])
        ids, word = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))
