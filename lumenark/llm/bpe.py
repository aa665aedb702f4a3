"""Byte-level BPE ids of a ``tokenizers`` file, remembered by space-delimited chunk.

The pre-tokeniser always starts a new piece at a single space that stands between
two non-space characters, so a text splits there without changing its ids. Each
distinct chunk is encoded once; a text is then a join of remembered byte strings
(little-endian unsigned 32-bit ids). ``tokenizers`` reads the file; its vocabulary,
whose ids are merge ranks, is handed to ``tiktoken``, which gives the same ids in
half the time for rare chunks (tests compare the two). A text that holds the string of
a special token goes to ``tokenizers`` whole: with ``specials`` its ids hold the special
token's, as that library gives them by default; without, the string is ordinary text."""

from __future__ import annotations

import os
import re
from array import array

_TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself
    where it prints in Latin-1, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ChunkedBpe:
    #: Chunks remembered before the memory is emptied: bounds the worker's memory.
    REMEMBER = 300_000
    #: Longer chunks (no spaces for long) are encoded but not remembered.
    LONG = 200

    def __init__(self, path: str, specials: bool = True, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        byte = {c: b for b, c in enumerate(_byte_characters())}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in self.tokenizer.get_vocab().items() if piece not in special}
        self.encoding = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def _ids(self, chunks: list[str]) -> list[bytes]:
        f = self.encoding.encode_ordinary
        return [array("I", f(c)).tobytes() for c in chunks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split, whole = [], {}
        for i, t in enumerate(texts):
            if t and self.special and self.special.search(t):
                whole[i] = array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
            if not t or i in whole:
                split.append([])
                continue
            # _CUT's \S next to a space: Python's white space holds all of the library's
            parts = _CUT.split(t) if _TWO_SPACES.search(t) else t.split(" ")
            split.append(parts)
        if len(self.known) > self.remember:
            self.known.clear()
        known, fresh, long = self.known, set(), {}
        for parts in split:
            fresh.update(parts[1:])
        fresh = [w for w in fresh if w not in known]
        short = [w for w in fresh if len(w) <= self.LONG]
        known.update(zip(short, self._ids([" " + w for w in short])))
        if len(short) < len(fresh):
            rest = [w for w in fresh if len(w) > self.LONG]
            long = dict(zip(rest, self._ids([" " + w for w in rest])))
        first = self._ids([parts[0] if parts else "" for parts in split])
        get = (lambda w: known[w] if w in known else long[w]) if long else known.__getitem__
        return [whole[i] if i in whole else a + b"".join(map(get, parts[1:])) for i, (a, parts) in enumerate(zip(first, split))]
