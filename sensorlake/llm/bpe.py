"""Token ids of a byte-level BPE file by the tokenizers library, with remembered ids for recurring units of text.

A byte-level tokenizer first cuts a text by a pattern, then merges inside each cut piece. No piece holds a
non-blank character followed by a blank one, so the place between a non-blank character and a space is always
a cut, whatever stands around it. A text is split there into units; ids of the units, concatenated, are the ids of the
text. Special strings hold no space, so they lie inside one unit and the library treats them as its default.
A unit of a space and letters is one piece, and a sign after letters begins another: these go straight to the model. Other units
of ASCII and Latin letters are cut by the tokenizer's own pattern, and the model gets each new piece once; all else goes to the library.
"""

from __future__ import annotations

import re
from array import array

from sensorlake.llm.common import quiet_threads, remembered

BLANK_THEN_SPACE = re.compile(r"\s ")
SIGNS = frozenset(".,;:!?")
SIMPLE = re.compile(r"[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Fixed value: the pattern of byte-level tokenizers, for simple units after at most one space. Every character of a text is in one piece.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def split_units(text: str) -> list[str]:
    """Pieces of the text, cut at each space that follows a non-blank character; that space is left out."""
    if BLANK_THEN_SPACE.search(text) is None and text[:1] != " ":
        return text.split(" ")
    parts = text.split(" ")
    units, open_unit = [], parts[0]
    for p in parts[1:]:
        if open_unit and not open_unit[-1].isspace():
            units.append(open_unit)
            open_unit = p
        else:
            open_unit = f"{open_unit} {p}"
    units.append(open_unit)
    return units


class UnitEncoder:
    """ids(texts): for each text its ids as little-endian uint32 bytes. Units are remembered in two generations of bounded size."""

    def __init__(self, path: str, most: int = 250_000, longest: int = 64):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.signs = {s: self._plain(s) for s in SIGNS}
        self.most, self.longest = most, longest
        self.pieces: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, letters: str) -> bytes:
        """Ids of a space and letters, one piece of the pattern."""
        mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(f"Ġ{mapped}")]).tobytes()

    def _cut(self, text: str) -> bytes:
        """Ids of a simple text by its pieces."""
        out = []
        pieces = PIECES.findall(text)
        assert sum(map(len, pieces)) == len(text), "the pattern left a character out"
        for p in pieces:
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.pieces[p] = array("I", [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]).tobytes()
            out.append(ids)
        return b"".join(out)

    def _learn(self, missing: list[str]) -> None:
        """Ids of units that stand after a space."""
        hard = []
        for u in missing:
            if u.isalpha():
                self.young[u] = self._piece(u)
            elif u[-1:] in SIGNS and u[:-1].isalpha():
                stem = self.young.get(u[:-1]) or self.old.get(u[:-1]) or self._piece(u[:-1])
                self.young[u] = stem + self.signs[u[-1]]
            elif len(u) <= self.longest and SIMPLE.fullmatch(u) and "<|" not in u:
                self.young[u] = self._cut(f" {u}")
            else:
                hard.append(u)
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            for u, e in zip(part, self.tokenizer.encode_batch_fast([f" {u}" for u in part], add_special_tokens=False), strict=True):
                self.young[u] = array("I", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes an id."""
        split = [split_units(t) if t else [] for t in texts]
        if len(self.pieces) > self.most // 2:
            self.pieces.clear()
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        missing = set().union(*[s[1:] for s in split]).difference(self.young)
        if self.old:
            known = missing.intersection(self.old)
            self.young.update((u, self.old[u]) for u in known)
            missing -= known
        self._learn(list(missing))
        get = self.young.__getitem__
        simple = [len(s[0]) <= self.longest and SIMPLE.fullmatch(s[0]) is not None and "<|" not in s[0] for s in split if s]
        hard = [s[0] for s, easy in zip((s for s in split if s), simple, strict=True) if not easy]
        firsts = iter([array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)])
        easy = iter(simple)
        out = [(self._cut(s[0]) if next(easy) else next(firsts)) + b"".join(map(get, s[1:])) if s else b"" for s in split]
        for u in missing:  # very long units are not worth remembering
            if len(u) > self.longest:
                self.young.pop(u, None)
        return out


def unit_encoder(path: str) -> UnitEncoder:
    return remembered(path, lambda: UnitEncoder(path))
