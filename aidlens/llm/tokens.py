"""Token ids of public tokenizers, word by word.

The ids of a text are those of its pieces between blanks, since every tokenizer here splits at
white space before it merges. The piece's ids are remembered, so a frequent word is merged once
per task and not once per occurrence.
"""

import base64
import re
import struct
from functools import lru_cache

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Letters that the normaliser leaves alone but for their case, then ASCII signs but the apostrophe.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@[-`{-~]*)")


def folder() -> str:
    """The folder of the tokenizers' files."""
    import public_tokenizers

    return public_tokenizers.path("")


class WordBpe(dict):
    """The word-level BPE as the bytes of its ids, four bytes each, little-endian.

    The first ``keep`` different pieces are remembered. Blanks, tabs and line ends separate
    pieces; any other white space is left to the tokenizer itself.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        super().__init__({"": b""})
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        shown = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        self.shown = str.maketrans({c: shown(c) for c in letters})

    def __missing__(self, piece: str) -> bytes:
        m = _PLAIN.fullmatch(piece)
        if m:
            word, signs = m[1].lower(), m[2]
            if not word.isascii():
                word = word.translate(self.shown)
            ids = [t.id for t in self.model.tokenize(word)] if word else []
            if signs:
                ids += [t.id for t in self.model.tokenize(signs)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        value = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.keep:
            self[piece] = value
        return value

    def encode(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, pieces))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


class ByteBpe:
    """The byte-level BPE, as counts."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a file, by its kind; a worker keeps it for its next tasks."""
    return WordBpe(path) if path.endswith(WORD_BPE) else ByteBpe(path)
