"""Byte-level BPE ids of whole texts, fast where words repeat."""

from __future__ import annotations

import base64
import re
from itertools import repeat
from struct import pack

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Chunks whose ids a worker remembers at most, and the longest one it remembers.
REMEMBERED = 400_000
LONGEST = 48


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a ``tokenizers`` byte-level BPE file, the same as its ``encode(..., add_special_tokens=False)``.

    The pattern that splits texts before merging never joins a space to what
    comes before it, unless white space is on both sides of that space. So
    all other texts are cut at spaces, and each distinct chunk is encoded once
    a worker, with the same vocabulary as ranks. Texts with such spaces, or
    with the string of a special token, are encoded whole. With ``escaped``
    strings of special tokens are ordinary text: their ids never occur.
    """

    _own: dict[tuple[str, str, bool], Encoder] = {}
    def __init__(self, json_path: str, ranks_path: str, pattern: str, escaped: bool) -> None:
        self.whole = Tokenizer.from_file(json_path)
        self.whole.encode_special_tokens = escaped
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self._whole = re.compile("|".join([r"\s \s|\s \Z", *([] if escaped else added)]))
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.part = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @classmethod
    def get(cls, json_path: str | None = None, ranks_path: str | None = None, escaped: bool = False) -> Encoder:
        """This worker's encoder for the files, by default the 50k vocabulary."""
        import public_tokenizers

        key = (json_path or default_path("byte_bpe_50k.json"), ranks_path or default_path("byte_bpe_50k.tiktoken"), escaped)
        if key not in cls._own:
            cls._own[key] = cls(*key[:2], public_tokenizers.PATTERN, escaped)
        return cls._own[key]

    def _chunk(self, chunk: str, lead: str) -> bytes:
        return pack(f"<{len(ids := self.part.encode_ordinary(lead + chunk))}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; none for a null text."""
        if not text:
            return b""
        if self._whole.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        known = self.known
        found = list(map(known.get, rest, repeat(None)))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = rest[i]
                    ids = known.get(chunk) or self._chunk(chunk, " ")
                    found[i] = ids
                    if len(chunk) <= LONGEST and len(known) < REMEMBERED:
                        known[chunk] = ids
        return b"".join([self._chunk(first, "") if first else b"", *found])
