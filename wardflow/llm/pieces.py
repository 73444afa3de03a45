"""Encoding by distinct pieces of text, kept from batch to batch of a worker.

A byte-level word pattern always starts a new match at a space that follows something other than white space. So a text
falls into pieces there, each piece encodes on its own, and a worker encodes each distinct piece once. Texts with white
space before a space, or with a literal of an added token, take the encoder's whole-text way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class PieceCache:
    """ids of texts as little-endian unsigned 32-bit bytes.

    ``encode_pieces`` takes distinct strings and gives the bytes of each; ``encode_text`` does the same for one whole
    text. ``limit`` bounds the kept pieces; beyond it the cache starts anew.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], Iterable[bytes]], encode_text: Callable[[str], bytes], limit: int = 1_200_000, literals: Iterable[str] = ()):
        self.encode_pieces, self.encode_text, self.limit = encode_pieces, encode_text, limit
        self.literals = list(literals)
        self.spaced: dict[str, bytes] = {}  # piece without its leading space: bytes of the piece with it

    def has_literal(self, text: str) -> bool:
        return any([x in text for x in self.literals])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if self.has_literal(t) else t.split(" ") for t in texts]
        if len(self.spaced) > self.limit:
            self.spaced.clear()
        heads = list({parts[0] for parts in split if parts} - {""})
        first = dict(zip(heads, self.encode_pieces(heads), strict=True)) | {"": b""}
        get, found, new = self.spaced.get, [], set()
        for parts in split:
            known = [first[parts[0]], *map(get, parts[1:])] if parts is not None else None
            found.append(known)
            if known is not None and None in known:
                new.update([p for p, ids in zip(parts, known, strict=True) if ids is None])
        listed = [p for p in new if p and not p[-1].isspace()]  # the others would lie before a space, or end the text
        self.spaced.update(zip(listed, self.encode_pieces([" " + p for p in listed]), strict=True))
        out = []
        for text, parts, known in zip(texts, split, found, strict=True):
            if parts is not None and None in known:
                known = [ids if ids is not None else get(p) for p, ids in zip(parts, known, strict=True)]
                if known[-1] is None:
                    known[-1] = self.encode_pieces([" " + parts[-1]])[0]
            if parts is None or None in known or len(parts) > 1 and parts[0][-1:].isspace():
                out.append(self.encode_text(text))
            else:
                out.append(b"".join(known))
        return out
