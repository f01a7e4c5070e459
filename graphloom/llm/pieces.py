"""A SentencePiece model file as tables: pieces, scores, byte pieces and the normaliser's settings."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: Where the public vocabulary files lie; every operator takes another path as a parameter.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: The key under which a trie's node holds the piece that ends there.
END = ""


def read_model(path: str = MODEL_PATH) -> bytes:
    """The file's bytes, read on the driver and sent to the workers with the task."""
    with open(path, "rb") as file:
        return file.read()


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """scores: log-weight of each normal piece; ids: their numbers; bytes_: the number of each byte."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_: dict[int, int] = {}
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.dummy_prefix, self.trim = True, True
        for number, value in _fields(data):
            if number == 1:
                self._add(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("only models whose normaliser has no character map are supported")
                self.dummy_prefix, self.trim = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if USER in self.kinds:
            raise ValueError("models with user-defined pieces are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("pieces that contain a space after a character are not supported")
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.characters = frozenset("".join(self.scores))
        self._pretoken = re.compile(self._cuts())

    def _cuts(self) -> str:
        """Matches the parts of a text that no piece reaches across the ends of.

        A part ends before a space that follows another character (pieces have spaces at their
        start only) and, if that's so in all pieces, around a line end and between a Latin letter
        and those signs that no piece has after one.
        """
        latin, lines = "A-Za-zÀ-ÖØ-öø-ɏ", "\n" if "\n" not in self.characters else ""
        after = {b for p in self.scores for a, b in zip(p, p[1:], strict=False) if re.match(f"[{latin}]", a)}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        letter, other = f"[{latin}]", f"[^{latin}{SPACE}{lines}]"
        onward = f"[^{latin}{SPACE}{lines}{signs}]"
        part = f"{SPACE}*{other}*{letter}+(?:{onward}{other}*{letter}*)*|{SPACE}*{other}+|{SPACE}+"
        return part + ("|\n" if lines else "")

    def _add(self, fields: dict) -> None:
        text, kind = fields[1].decode(), fields.get(3, NORMAL)
        number = len(self.pieces)
        self.pieces.append(text)
        self.kinds.append(kind)
        if kind == NORMAL:
            self.scores[text] = struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0
            self.ids[text] = number
        elif kind == BYTE:
            self.bytes_[int(text[1:-1], 16)] = number
        elif kind == UNKNOWN:
            self.unknown = number

    def parts(self, normalised: str) -> list[str]:
        """A normalised text cut where no piece can reach across: before spaces, and around line ends."""
        return self._pretoken.findall(normalised)

    def fallback(self, character: str) -> list[int]:
        """The numbers for a character that is in no piece."""
        if self.byte_fallback:
            return [self.bytes_[b] for b in character.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def decode(self, ids) -> str:
        """The text of a sequence of numbers: pieces and runs of bytes, spaces restored."""
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(int(self.pieces[i][1:-1], 16))
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(self.pieces[i] if kind == NORMAL else " ⁇ " if kind == UNKNOWN else "")
        if run:
            parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def model_of(data: bytes) -> PieceModel:
    return PieceModel(data)
