"""Public tokenizers on whole texts, with the ids of words kept from text to text.

Byte-level BPE first cuts a text before every single space that stands between two other
characters, so what such a cut gives can be encoded by itself, and most of it recurs.
"""

from __future__ import annotations

import re

import numpy as np

#: Words whose ids a worker keeps, at most; then it starts afresh.
KEPT_WORDS = 700_000
#: A space beside other space, and what counts as space beyond ASCII's.
MEETING = ("  ", *(x for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" for x in (" " + c, c + " ")))
RARE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Kept(dict):
    """Values of words, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        out = self[word] = self.make(word)
        return out

    def trim(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()


class ByteBPE:
    """Ids of whole texts by a tokenizers file, as little-endian unsigned 32-bit numbers.

    ranks: the same vocabulary as a tiktoken file, which encodes new words four times as fast.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import base64
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        encode = self.fast.encode_ordinary
        self.first = Kept(lambda w: np.array(encode(w), "<u4").tobytes())
        self.later = Kept(lambda w: np.array(encode(" " + w), "<u4").tobytes())

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        # Where spaces meet other space, or a special token stands, the text is encoded in one piece.
        if text[0] == " " or text[-1] == " " or any(p in text for p in MEETING) or not text.isascii() and RARE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words = text.split(" ")
        self.first.trim()
        self.later.trim()
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))


class PieceBPE:
    """Ids of words by a sentencepiece file, each word by itself, as 16-bit numbers."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.model.get_piece_size())])
        encode = self.model.encode
        self.kept = Kept(lambda w: np.array(encode(w.decode()), np.uint16).tobytes())

    def encode(self, words: list[bytes]) -> np.ndarray:
        self.kept.trim()
        return np.frombuffer(b"".join(map(self.kept.__getitem__, words)), np.uint16)
