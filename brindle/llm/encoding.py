"""Token ids of whole texts, exactly as the tokenizers library gives them.

Encoding a text piece by piece gives the ids of the whole where pieces meet at
a boundary that the tokenizer itself never crosses.  The pieces repeat, so
their ids are remembered as bytes and a document's ids are a join of bytes:

* ``word_bpe_49k.json`` drops white space; pieces meet at spaces and line ends.
* ``byte_bpe_50k.json`` joins one space to the word after it; pieces meet
  before a single space, and around a single line end, between other characters.

Texts in which that does not hold (other runs of white space, special tokens'
strings, NUL) are encoded whole.  The memory of pieces belongs to the worker
process, so that its tasks share it, and is bounded: once it is full, further
pieces are encoded each time.

Most new pieces are a word of Latin letters and some punctuation.  The
pre-tokenizers cut these into the word and the punctuation, so the library's
model gets the word directly; all other pieces go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

#: Pieces that a worker process remembers for a tokenizer, of at most PIECE_CHARS each: about 200 bytes a piece.
CACHE_PIECES, PIECE_CHARS = {"word_bpe_49k.json": 900_000, "byte_bpe_50k.json": 500_000}, 64

#: White space that is not a single space or line end between other characters (fixed: the white space of Unicode, and Python's).
IRREGULAR = ("  ", "\n\n", " \n", "\n ", *map(chr, (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: A word and punctuation that both pre-tokenizers cut in two (the apostrophe may open a contraction).
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte: itself, or the next code point from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def tokenizer_path(name: str) -> str:
    """A path as it is; the name of a public vocabulary file through its package."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(tokenizer)
        self.tok = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.split = {"word_bpe_49k.json": self.by_word, "byte_bpe_50k.json": self.by_space}.get(os.path.basename(path))
        self.most = CACHE_PIECES.get(os.path.basename(path), 0)
        self.fold = self.split == self.by_word
        self.bytes_as = byte_characters()
        self.space = self.bytes_as[32]
        self.tails: dict[str, bytes] = {"": b""}
        # Functions are shipped by value, so the process-wide memory lives beside the modules.
        shared = sys.modules.setdefault("_brindle_pieces", types.ModuleType("_brindle_pieces"))
        self.known: dict[str, bytes] = shared.__dict__.setdefault(path, {"": b""})

    @staticmethod
    def by_word(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def by_space(self, text: str) -> list[str] | None:
        if any(c in text for c in IRREGULAR):
            return re.split(r"(?<=\S)(?= \S)", text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that are not remembered."""
        out, hard, tokenize, tails = {}, [], self.tok.model.tokenize, self.tails
        for p in pieces:
            m = SIMPLE.fullmatch(p)
            if m is None or (self.fold and p[0] == " "):
                hard.append(p)
                continue
            word, tail = m.groups()
            word = word.lower() if self.fold else word
            word = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.bytes_as)
            if tail not in tails:
                if len(tails) > 10_000:
                    hard.append(p)
                    continue
                tails[tail] = self.whole([tail])[0]
            out[p] = array("I", [t.id for t in tokenize(word)]).tobytes() + tails[tail]
        if hard:
            out.update(zip(hard, self.whole(hard), strict=True))
        return out

    def ids(self, text: str) -> bytes:
        if self.split is None or "\0" in text or any(s in text for s in self.special):
            return self.whole([text])[0]
        pieces, known = self.split(text), self.known
        got = list(map(known.get, pieces))
        if None in got:
            gaps = [i for i, b in enumerate(got) if b is None]
            fresh = self.fresh({pieces[i] for i in gaps})
            for i in gaps:
                got[i] = fresh[pieces[i]]
            if len(known) < self.most:
                known.update((p, b) for p, b in fresh.items() if len(p) <= PIECE_CHARS)
        return b"".join(got)
