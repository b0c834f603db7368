"""Cut text for byte-level byte-pair vocabularies into units whose tokens do not depend on what stands around them."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from itertools import islice
from typing import Any

#: Fixed value: the split pattern that byte-level vocabularies of this family are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain(text: str) -> bool:
    """Whether the white space in ``text`` is single spaces and line feeds between other characters.

    Then a pre-token begins at each space and each line feed is one by itself.
    """
    return len(text.split()) == text.count(" ") + text.count("\n") + 1


def keys(text: str) -> list:
    """Keys of the units of ``text`` in order, the first one behind a line feed that isn't in the text.

    A word stands for a space and itself, one that starts with a line feed for
    itself. A text whose white space isn't plain is one key, a tuple, behind that
    line feed.
    """
    return ("\n" + text.replace("\n", " \n")).split(" ") if plain(text) else ["\n", (text,)]


def unit(key: str | tuple[str]) -> str:
    """The text that a key stands for."""
    return key[0] if isinstance(key, tuple) else key if key[:1] == "\n" else " " + key


class Memory:
    """Values of keys that a Python worker keeps between batches, worked out for all new keys of a batch together.

    When it would hold more than ``size`` keys it forgets those learnt last: the
    ones met first are the frequent ones. That bounds memory and changes no result.
    """

    def __init__(self, learn: Callable[[list], Iterable], size: int):
        self.learn, self.size, self.known = learn, size, {}

    def of(self, cuts: list[list[Hashable]]) -> Callable[[Hashable], Any]:
        """A function that gives the value of any key in ``cuts``."""
        every = set().union(*cuts)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > self.size:
            self.known = dict(islice(self.known.items(), self.size // 2))
            new = list(every.difference(self.known))
        self.known.update(zip(new, self.learn(new)))
        return self.known.__getitem__
