"""Token ids of whole texts by a public byte-level tokenizer.

The tokenizer splits a text before it merges, and never across a single space between two
other characters.  So a text is cut there, each distinct chunk is encoded once per worker,
and the ids of a text are those of its chunks in order.  New chunks are encoded together, as
one text; since a token stands for whole bytes, the bytes tell where a chunk's ids end.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Chunks whose ids a worker remembers.
KNOWN_CHUNKS = 1_500_000
#: New chunks encoded as one text.
JOINED = 2_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def chunks(text: str) -> list[str]:
    """A text cut at single spaces between other characters."""
    if ("  " in text or "\n " in text or " \n" in text or text[:1].isspace() or text[-1:].isspace()
            or _OTHER_SPACE.search(text)):
        return _CUT.split(text)
    return text.split(" ")


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit bytes; equal to encoding each whole text."""

    def __init__(self, path: str, known: int = KNOWN_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark already uses every core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._tokenizer, self._limit, self._heads, self._tails = tokenizer, known, {}, {}
        # A byte-level vocabulary writes each byte as one character; added tokens are plain text.
        sizes = {i: len(x) for x, i in tokenizer.get_vocab(with_added_tokens=False).items()}
        sizes |= {x["id"]: len(x["content"].encode()) for x in json.loads(tokenizer.to_str())["added_tokens"]}
        self._sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])

    def _encode(self, new: list[str], before: str) -> dict[str, bytes]:
        """Ids of chunks, each with ``before`` in front."""
        if not before:   # beginnings of texts have nothing to hold them apart
            coded = self._tokenizer.encode_batch_fast(new, add_special_tokens=False)
            return {x: np.array(c.ids, "<u4").tobytes() for x, c in zip(new, coded)}
        groups = [new[i:i + JOINED] for i in range(0, len(new), JOINED)]
        coded = self._tokenizer.encode_batch_fast([before + before.join(g) for g in groups], add_special_tokens=False)
        found = {}
        for group, c in zip(groups, coded):
            ids = np.array(c.ids, "<u4")
            ends = np.cumsum([len(x.encode("utf-8")) + len(before) for x in group])
            # A token of no bytes would break this; a byte-level vocabulary has none.
            cuts = 4 * (np.searchsorted(np.cumsum(self._sizes[ids]), ends) + 1)
            flat, at = ids.tobytes(), 0
            for chunk, cut in zip(group, cuts.tolist()):
                found[chunk] = flat[at:cut]
                at = cut
        return found

    def _ids(self, known: dict, seen: set[str], before: str) -> dict:
        """Ids of all chunks seen; ``known`` takes them up while it has room."""
        found = self._encode(list(seen.difference(known)), before)
        if len(known) + len(found) <= self._limit:
            known.update(found)
            return known
        return {**{x: known[x] for x in seen if x in known}, **found}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parts = [chunks(x or "") for x in texts]
        first = [x.pop(0) for x in parts]
        heads = self._ids(self._heads, set(first), "")
        tails = self._ids(self._tails, set().union(*parts), " ")
        return [heads[x] + b"".join(map(tails.__getitem__, p)) for x, p in zip(first, parts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker and tokenizer file."""
    return ChunkEncoder(path)


def public_path(name: str) -> str:
    """Place of an installed public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
