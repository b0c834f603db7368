"""Exact token counts by rank-synchronous merging of whole batches of pre-tokens in numpy arrays."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quillrank.llm.common import by_piece
from quillrank.llm.pretokens import PATTERN, Memory, keys, unit

#: Units whose counts a Python worker remembers between batches.
REMEMBERED = 600_000

#: Above every rank.
NEVER = np.int32(2**31 - 1)

_counters: dict[str, "TokenCounter"] = {}


class PairTable:
    """Rank of each pair of neighbours and the symbol that it merges to, looked up for whole arrays at once.

    A slot of a hashed array names one rule; rules whose slot is taken go to a
    sorted list that only pairs with an occupied, different slot are sought in.
    """

    def __init__(self, keys: np.ndarray, result: np.ndarray, width: int, bits: int = 20):
        self.keys, self.result, self.width, self.shift = keys, result.astype(np.int32), width, np.uint64(64 - bits)
        slot = self._slot(keys)
        self.slots = np.full(1 << bits, len(keys), np.int32)
        self.slots[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.keys = np.r_[keys, -1]
        rest = np.flatnonzero(self.slots[slot] != np.arange(len(keys)))
        self.rest = rest[np.argsort(keys[rest])].astype(np.int32)
        self.rest_keys = keys[self.rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NEVER`` where it doesn't merge."""
        key = left.astype(np.int64) * self.width + right
        place = self.slots[self._slot(key)]
        other = np.flatnonzero((self.keys[place] != key) & (place < len(self.result)))
        place[place == len(self.result)] = NEVER
        if len(other):
            place[other] = NEVER
            if len(self.rest):
                at = np.minimum(np.searchsorted(self.rest_keys, key[other]), len(self.rest) - 1)
                found = self.rest_keys[at] == key[other]
                place[other[found]] = self.rest[at[found]]
        return place


def merge_count(symbols: np.ndarray, sizes: np.ndarray, rules: PairTable) -> np.ndarray:
    """How many symbols are left of each sequence after all merges.

    ``symbols`` holds the sequences one after the other, ``sizes`` their lengths.
    In one round every sequence applies its own lowest-ranked pair wherever it
    occurs; finished sequences leave the arrays.
    """
    counts = np.asarray(sizes, np.int64).copy()
    who = np.flatnonzero(counts > 1)
    s, n = symbols[np.repeat(counts > 1, counts)].astype(np.int32), counts[who]
    last = np.zeros(len(s) + 1, bool)
    last[np.cumsum(n) - 1] = True
    last = last[: len(s)]
    rank = np.full(len(s), NEVER, np.int32)
    inner = np.flatnonzero(~last)
    rank[inner] = rules.rank(s[inner], s[inner + 1])
    while len(n):
        starts = np.cumsum(n) - n
        lowest = np.minimum.reduceat(rank, starts)
        going = lowest < NEVER
        if not going.all():
            counts[who[~going]] = n[~going]
            keep = np.repeat(going, n)
            s, last, rank = s[keep], last[keep], rank[keep]
            who, n, lowest = who[going], n[going], lowest[going]
            if not len(n):
                break
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        at = np.flatnonzero(rank == lowest[owner])
        if len(at) > 1 and (next_to := np.diff(at) == 1).any():
            # x x x: of a chain of overlapping hits the first, third, ... apply. Chains end with their sequence,
            # for its last symbol has no pair.
            step = np.arange(len(at))
            place = step - np.maximum.accumulate(np.where(np.r_[True, ~next_to], step, 0))
            at = at[place % 2 == 0]
        s[at] = rules.result[rank[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        n = n - np.bincount(owner[at], minlength=len(n))
        at = at - np.arange(len(at))
        s, last, rank = s[keep], last[keep], rank[keep]
        rank[at] = NEVER
        before = at[at > 0] - 1
        for near in (at, before):
            near = near[~last[near]]
            rank[near] = rules.rank(s[near], s[near + 1])
    return counts


class TokenCounter:
    """Counts tokens of texts under the byte-level vocabulary in one ``.json`` file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = len(vocabulary) + 1
        left, right = (np.array([vocabulary[m[side]] for m in merges], np.int64) for side in (0, 1))
        result = np.array([vocabulary[m[0] + m[1]] for m in merges], np.int64)
        key = left * self.width + right
        self.rules = PairTable(key, result, self.width)
        self.first = np.array([vocabulary[c] for c in _byte_letters()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.memory = Memory(self.units, REMEMBERED)

    def sequences(self, words: Sequence[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        return merge_count(self.first[flat], sizes, self.rules)

    def units(self, new: list) -> list[int]:
        """Tokens of the units behind keys; their distinct pre-tokens are counted together."""
        cut = [self.split(unit(k)) for k in new]
        distinct = list({w for words in cut for w in words} - set(self.special))
        count = dict(zip(distinct, self.sequences(distinct).tolist())) | dict.fromkeys(self.special, 1)
        return [sum([count[w] for w in words]) for words in cut]

    def split(self, text: str) -> list[str]:
        """Pre-tokens; a special string is one by itself."""
        for special in self.special:
            if special in text:
                break
        else:
            return self.pattern.findall(text)
        out: list[str] = []
        for number, part in enumerate(self.cut.split(text)):
            out += [part] if number % 2 else self.pattern.findall(part)
        return out

    def __call__(self, texts: Sequence[str]) -> list[int]:
        """Tokens of each text."""
        cuts = [keys(t) for t in texts]
        got, feed = self.memory.of(cuts), self.sequences(["\n"])[0].item()
        return [sum(map(got, cut)) - feed for cut in cuts]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def counter(path: str) -> TokenCounter:
    """One counter per worker and vocabulary."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every document.

    ``path`` is a byte-level byte-pair vocabulary in the tokenizers library's JSON
    form. Counts equal that library's without begin, end or added tokens; special
    strings inside a text are one token each. A null text counts as empty (0, 0,
    false). Repeated rows give repeated rows, an empty table none; other columns
    are not read. Nothing is shuffled; a task holds one piece of its texts.
    """

    def work(ids: list, texts: list[str]) -> dict[str, list]:
        tokens = counter(path)(texts)
        return {key: ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens]}

    kind = docs.select(key).schema[0].dataType.simpleString()
    return by_piece(docs.select(key, text), work, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
