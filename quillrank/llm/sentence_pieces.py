"""Byte-pair pieces by a table of each prefix's last piece, and text from pieces."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from quillrank.llm.common import by_piece
from quillrank.llm.pretokens import Memory

#: Fixed value: the character that stands for a space in a piece.
SPACE = "▁"
#: Fixed value: how the piece of a single byte is written.
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Units of text a Python worker remembers between batches.
REMEMBERED = 1_000_000
#: Stands in the prefix table for a character that is in no piece.
ALONE = -1

_codecs: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """Ids of text and text of ids under one merge-type model with byte fallback.

    A piece's score is the priority of the merge that makes it. For every prefix of
    a text there is one piece that its encoding ends with: of the pieces that end
    there, found by an automaton, the one that the prefix before it, whose own last
    piece is in the table, can stand beside without the two growing together
    otherwise. Ids are read off the table from the end.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.score = [model.get_score(i) for i in ids]
        self.ids = {self.pieces[i]: i for i in ids if i not in special}
        self.silent = {i for i in ids if model.is_control(i)}
        self.byte_ids = {int(BYTE.fullmatch(self.pieces[i])[1], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = model.unk_id()
        #: What a text is cut at: no piece goes over a line feed, so that it ends a unit.
        self.lines = not any("\n" in p for p in self.ids)
        self.runs = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.memory = Memory(self.learn, REMEMBERED)
        whole = {p: i for p, i in self.ids.items() if self._made(i) is not False}
        self.automaton = ahocorasick.Automaton()
        for piece, i in whole.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    # What a piece is made of

    def _made(self, piece: int) -> tuple[int, int] | None | bool:
        """The two pieces that the last merge of ``piece`` joins; None for a character, False if it never comes about."""
        if piece not in self.parts:
            text, found = self.pieces[piece], False
            if len(text) == 1:
                found = None
            else:
                now = list(text)
                while len(now) > 1:
                    # The best pair merges first, the left one of equals.
                    joined = ((self.ids.get(now[k] + now[k + 1]), -k) for k in range(len(now) - 1))
                    best = max(((self.score[i], k) for i, k in joined if i is not None), default=None)
                    if best is None:
                        break
                    k = -best[1]
                    last = now[k], now[k + 1]
                    now[k : k + 2] = [now[k] + now[k + 1]]
                if len(now) == 1:
                    found = tuple(self.ids.get(x, x) for x in last)
            self.parts[piece] = found
        return self.parts[piece]

    def _edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """What stands at an end of ``piece`` from the first character to itself, each with the score of what consumes it."""
        if piece not in self.edges[side]:
            chain, at, score = [], piece, float("-inf")
            while True:
                text = self.pieces[at] if isinstance(at, int) else at
                chain.append((text, score))
                made = self._made(at) if isinstance(at, int) else None
                if not made:
                    break
                score, at = self.score[at], made[side]
            self.edges[side][piece] = chain[::-1]
        return self.edges[side][piece]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` come about side by side: at no time would what meets at their border have merged."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = a[i], b[j]
            joined = self.ids.get(x + y)
            if joined is not None and self.score[joined] > x_goes and self.score[joined] >= y_goes:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            # The merge with the better score comes first; of equals, the left one.
            if j + 1 == len(b) or i + 1 < len(a) and x_goes >= y_goes:
                i += 1
            else:
                j += 1

    # Encoding

    def table(self, text: str) -> list[int]:
        """For each prefix that ends a character, its last piece."""
        last, fit, fits = [ALONE] * (len(text) + 1), self.fit, self._fits
        done = -1
        for end, (piece, size) in self.automaton.iter(text):
            if end == done:
                continue
            before = last[end - size + 1]
            if before == ALONE:
                # The text's start, or a character of no piece; a shorter piece may only stand there if that is so.
                if end - size >= 0 and text[end - size] in self.ids:
                    continue
            elif (known := fit.get((before, piece))) is None:
                known = fit[before, piece] = fits(before, piece)
                if not known:
                    continue
            elif not known:
                continue
            last[end + 1] = piece
            done = end
        return last

    def recover(self, text: str, last: list[int], start: int, end: int) -> list[int]:
        """Ids of ``text[start:end]`` from the table, read from its end."""
        out: list[int] = []
        while end > start:
            piece = last[end]
            if piece == ALONE:
                raw = text[end - 1].encode("utf-8", "surrogatepass")
                out += [self.byte_ids.get(b, self.unknown) for b in reversed(raw)] if self.byte_ids else [self.unknown]
                end -= 1
            else:
                out.append(piece)
                end -= len(self.pieces[piece])
        return out[::-1]

    def encode_units(self, units: Sequence[str]) -> list[list[int]]:
        """Ids of units, each by itself; their tables are made in one run, with a character of no piece between them."""
        gap = next(c for c in "\n\0\x01\x02" if c not in self.ids)
        text = gap.join(units) + gap
        last, at, out = self.table(text), 0, []
        for unit in units:
            out.append(self.recover(text, last, at, at + len(unit)))
            at += len(unit) + 1
        return out

    def keys(self, text: str) -> list:
        """Keys of the units of ``text``: a word stands for a space and itself, one with a line feed first for itself."""
        if not text:
            return []
        if self.runs:
            return [(SPACE + text.replace(" ", SPACE),)]
        text = text.replace(SPACE, " ")
        if self.lines and "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        return [(unit.replace(" ", SPACE),) for unit in re.findall(" +[^ ]*", " " + text)]

    def known(self, texts: Sequence[str]) -> list[list[tuple[str, int, str]]]:
        """For each text, of each of its units: ids joined by commas, their number, their text."""
        cuts = [self.keys(t) for t in texts]
        got = self.memory.of(cuts)
        return [list(map(got, cut)) for cut in cuts]

    def learn(self, new: list) -> list[tuple[str, int, str]]:
        """Ids joined by commas, their number and their text for the units behind keys."""
        units = [k[0] if isinstance(k, tuple) else k if k[:1] == "\n" else SPACE + k for k in new]
        return [(",".join(map(str, ids)), len(ids), self.text(ids)) for ids in self.encode_units(units)]

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return [int(i) for ids, _, _ in self.known([text])[0] for i in ids.split(",")]

    # Decoding

    def text(self, ids: Sequence[int]) -> str:
        """The characters that the pieces write, without taking away a first space."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_characters(raw))
                raw = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out) + _characters(raw)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids; the space put before the first word goes."""
        shown = [i for i in ids if i not in self.silent]
        text = self.text(shown)
        return text[1:] if shown and self.pieces[shown[0]].startswith(SPACE) else text


def _characters(raw: bytearray) -> str:
    """UTF-8 bytes as characters; each byte that is part of none gives the replacement character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + size]).decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def codec(path: str) -> PieceCodec:
    """One codec per worker and model."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False,
                  remembered: int = REMEMBERED) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` also ids and decoded) of every document.

    Ids equal the sentencepiece library's for the merge-type model in ``path``
    without begin and end ids; ids are then decoded. A null text counts as empty: no
    ids, an empty decoded text. Repeated rows give repeated rows, an empty table
    none; other columns are not read. Nothing is shuffled; a task holds one piece
    of its texts, and a worker the results of ``remembered`` units.
    """

    def work(keys: list, texts: list[str]) -> dict[str, list]:
        codec(path).memory.size = remembered
        units = codec(path).known(texts)
        numbers = [",".join([u[0] for u in unit]) for unit in units]
        decoded = ["".join([u[2] for u in unit]).removeprefix(" ") for unit in units]
        out = {key: keys, "n_tokens": [sum([u[1] for u in unit]) for unit in units],
               "ids_sha256": _sha256(numbers), "decoded_sha256": _sha256(decoded)}
        if ids:
            out |= {"ids": [[int(i) for i in n.split(",")] if n else [] for n in numbers], "decoded": decoded}
        return out

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_piece(docs.select(key, text), work, schema + ", ids array<int>, decoded string" * ids)


def _sha256(texts: list[str]) -> list[str]:
    return [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
