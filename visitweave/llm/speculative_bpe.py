"""Byte-pair encoding that guesses and verifies.

A word is first cut greedily into the longest tokens.  A sequence of tokens is what merging
gives exactly if every two neighbours are compatible, that is if no merge across their border
would have come before the merges that built them.  All neighbours of all new words are tested
together, as arrays; only words with an incompatible pair are merged exactly.

Stretches with other characters than ASCII are composed, lower-cased and cut into words by the tokenizer's
own rules, since its Unicode tables are not Python's; their words are guessed, verified and merged as all others.

Defined results: a null text counts as empty and has no ids; the tokenizer's own marks inside a
text become their ids; repeated rows are encoded one by one; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from hashlib import sha256
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from visitweave.llm.common import small_batches, table
from visitweave.llm.registry import query
from visitweave.llm.token_ids import public_path

TOKENIZER = "word_bpe_49k.json"
#: Stretches between spaces whose ids a worker remembers.
KNOWN_CHUNKS = 600_000
NEVER = np.int64(1 << 40)
# Unicode white space, and control characters that Python alone takes for it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_PYTHON_SPACE = re.compile("[\x1c-\x1f]")
_NOT_WHITE = re.compile(f"[^{WHITE}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens with the merge that makes each, as arrays."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.ids, self.end = tokens, end
        n = max(tokens.values(), default=-1) + 1
        self.text: list[str] = [""] * n
        for text, i in tokens.items():
            self.text[i] = text
        # The rank of the merge that makes a token and its two parts; none for single bytes.
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, whole = tokens[a], tokens[b], tokens[a + b]
            self.pairs.setdefault((x, y), (rank, whole))
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, x, y
        codes = np.array([a * n + b for a, b in self.pairs], np.int64)
        order = np.argsort(codes)
        self._codes = codes[order]
        self._ranks = np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        self.size = n
        self._mark_proper(len(merges))
        self.longest = max((len(x.removesuffix(end)) for x in self.proper), default=1)

    def _mark_proper(self, n_merges: int) -> None:
        """Tokens that merging their own bytes gives, so that a guess may use them."""
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(self.size, bool)
        later = (self.rank[self.left[made]] < self.rank[made]) & (self.rank[self.right[made]] < self.rank[made])
        sound[made] = later & self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:   # parts come before what they make
            sound[i] = sound[i] and sound[self.left[i]] and sound[self.right[i]]
        self.proper = {x: i for x, i in self.ids.items() if sound[i] and (self.rank[i] >= 0 or len(x.removesuffix(self.end)) == 1)}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NEVER`` without one."""
        if not len(self._codes):
            return np.full(len(a), NEVER)
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether token ``b`` may follow token ``a``, before the merge of rank ``limit``.

        It goes back in time: of the two parts that meet at the border, the one made last is
        taken apart, so every pair of parts that ever met is seen once.  A merge of the two
        comes first if it ranks before the merge that took up the left part, and not after
        the one that took up the right part (of equal merges the leftmost goes first).
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        until_a = np.full(len(a), NEVER) if limit is None else np.array(limit, np.int64)
        until_b = np.full(len(a), NEVER) if limit is None else np.array(limit, np.int64) - 1
        fine, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            rank = self.pair_ranks(x, y)
            crossed = (rank < until_a[open_]) & (rank <= until_b[open_]) & (rank < NEVER)
            fine[open_[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            split_a, split_b = ~crossed & (rx >= 0) & (rx > ry), ~crossed & (ry >= 0) & (ry >= rx)
            at = open_[split_a]
            until_a[at], a[at] = rx[split_a], self.right[x[split_a]]
            at = open_[split_b]
            until_b[at], b[at] = ry[split_b], self.left[y[split_b]]
            open_ = open_[split_a | split_b]
        return fine

    def guess(self, word: str) -> list[int] | None:
        """Longest tokens from left to right; the last one carries the word's end."""
        found, at, n, proper = [], 0, len(word), self.proper
        while at < n:
            if n - at <= self.longest:
                last = proper.get(word[at:] + self.end)
                if last is not None:
                    found.append(last)
                    return found
            for to in range(min(n - 1, at + self.longest), at, -1):
                token = proper.get(word[at:to])
                if token is not None:
                    found.append(token)
                    at = to
                    break
            else:
                return None
        return found

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, of equal ones the leftmost."""
        parts = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.end]]
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.pairs]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = self.pairs[pair][1], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts):
                    new = (parts[k], parts[after[k]])
                    if new in self.pairs:
                        heapq.heappush(queue, (self.pairs[new][0], k, new))
        return [x for x in parts if x is not None]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of words (as byte characters)."""
        found = [self.guess(x) for x in words]
        sizes = np.array([len(x) if x else 0 for x in found], np.int64)
        flat = np.array([i for x in found if x for i in x], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        codes, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(codes // self.size, codes % self.size)[where] if len(codes) else np.ones(0, bool)
        wrong = set(word[inner[~fine]].tolist()) | {i for i, x in enumerate(found) if x is None}
        return [self.merge(words[i]) if i in wrong else x for i, x in enumerate(found)]


class SpeculativeBpe:
    """Ids and decoded texts of whole texts, as the tokenizer in ``path`` gives them."""

    def __init__(self, path: str, known: int = KNOWN_CHUNKS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocabulary = Vocabulary(model["vocab"], pairs, model["end_of_word_suffix"])
        whole = Tokenizer.from_file(path)
        self._composed, self._pre_split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self._marks = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._marks_begin = commonprefix(list(self._marks))
        self._cut_marks = re.compile("(" + "|".join(map(re.escape, sorted(self._marks, key=len, reverse=True))) + ")")
        self._words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(
            "[^\\s", "[^" + WHITE))
        self._characters = dict(enumerate(byte_characters()))
        self._known, self._limit = {}, known

    def _chunks(self, text: str) -> list[str]:
        """Stretches between white space, of plain texts in lower case."""
        if text.isascii():
            text = text.lower()
        return _NOT_WHITE.findall(text) if _PYTHON_SPACE.search(text) else text.split()

    def _split(self, chunk: str) -> list[str]:
        """Words of a chunk, as byte characters."""
        if chunk.isascii():
            return [self._spelled(w) for w in self._words.findall(chunk.lower())]
        return [w for w, _ in self._pre_split(self._composed(chunk))]

    def _spelled(self, word: str) -> str:
        return word if word.isprintable() else word.translate(self._characters)

    def _learn(self, seen: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and decoded text of each chunk."""
        new = list(seen.difference(self._known))
        split = [self._split(x) for x in new]
        words = list({w for x in split for w in x})
        ids = dict(zip(words, self.vocabulary.encode(words)))
        text, found = self.vocabulary.text, {}
        for chunk, own in zip(new, split):
            whole = [i for w in own for i in ids[w]]
            found[chunk] = (np.array(whole, "<u4").tobytes(), " ".join([text[i] for i in whole]).encode())
        if len(self._known) + len(found) <= self._limit:
            self._known.update(found)
            return self._known
        return {**{x: self._known[x] for x in seen if x in self._known}, **found}

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """``(ids, decoded text)`` of each text; ids as little-endian unsigned 32-bit numbers."""
        marked = []
        for text in texts:
            text = text or ""
            pieces = self._cut_marks.split(text) if self._marks and self._marks_begin in text else [text]
            marked.append([x if i % 2 else self._chunks(x) for i, x in enumerate(pieces)])
        known = self._learn({c for pieces in marked for x in pieces[::2] for c in x})
        out = []
        for pieces in marked:
            found = []
            for i, x in enumerate(pieces):
                if i % 2:
                    found.append((np.array([self._marks[x]], "<u4").tobytes(), x.encode()))
                else:
                    found += map(known.__getitem__, x)
            ids, decoded = zip(*found) if found else ((), ())
            out.append((b"".join(ids), b" ".join([x for x in decoded if x])))
        return out


@lru_cache(maxsize=2)
def speculative(path: str) -> SpeculativeBpe:
    """One encoder per worker and tokenizer file."""
    return SpeculativeBpe(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every document; ids as little-endian unsigned 32-bit numbers."""
    return _mapped(docs, path, "ids binary, decoded binary", lambda ids, text: (ids, text), (pa.binary(), pa.binary()))


def _mapped(docs, path, schema, of, kinds):
    path = path or public_path(TOKENIZER)
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encode = speculative(path)
        for batch in batches:
            rows = [of(*x) for x in encode(batch.column(1).to_pylist())]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(x), t) for x, t in zip(columns, kinds)]], ["doc_id", *names])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda ids, text: (len(ids) // 4, sha256(ids).hexdigest(), sha256(text).hexdigest()),
                   (pa.int64(), pa.string(), pa.string()))


@query("op8_speculative_bpe")
def op8_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
