"""Byte-level BPE over a pair occurrence index.

Each block of documents is reduced to the distinct words it has not met yet.
Their bytes form one symbol sequence, and an index maps every adjacent pair
that has a merge rank to all its positions.  Ranks are taken in ascending
order: all positions of the lowest active pair are merged, left to right, and
only the lists of the pairs beside them change.

A worker remembers the words that it has met, so a word is merged once.

Texts are split into words by a fast pattern.  The ``regex`` module may know
letters and numbers that the tokenizers library does not (they follow different
Unicode versions), so the library's own classes are read from it once for each
worker, and texts that hold a character on which the two differ are split again
by a pattern of the library's classes.

Defined results: null texts count as empty; an empty text has no tokens and
decodes to itself; special strings become their special ids, as the
tokenizers library does by default; rows that repeat are encoded each; a very
long text is encoded whole, in a block of its own, and a very long unbroken
word is merged like any other but not remembered.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same with the classes of letters and numbers left open.
CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"

#: Words that a Python worker remembers in each of two generations, and characters encoded at once.
CACHE_WORDS = 600_000
#: Longer words are not remembered, so that what is remembered is bounded in bytes as well.
CACHE_CHARS = 256
BLOCK_CHARS = 2_000_000
#: Token ids fit into so many bits; a pair's key is its left id, shifted, and its right id.
ID_BITS = 20

_BEFORE_SPACE = re.compile(r" (?=\s|\Z)")
_NO_SPACE = "\ud800"  # marks a piece without a leading space; never part of a text


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by a rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(chars: list[str]) -> str:
    """The inside of a character class that holds ``chars``, given in ascending order."""
    points = np.array(list(map(ord, chars)))
    cuts = np.flatnonzero(np.diff(points) > 1)
    first, last = points[np.r_[0, cuts + 1]] if len(points) else points, points[np.r_[cuts, -1]] if len(points) else points
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


@lru_cache(maxsize=2)
def borders(path: str) -> tuple[str, str]:
    """(word pattern, class of odd characters) of a vocabulary file, as the tokenizers library has them.

    The library splits a text of all characters in ascending order into runs of
    one class, and each run's class shows by what it joins.  Odd are those of
    which the ``regex`` module thinks otherwise.  Planes 4 and up hold neither
    letters nor numbers.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x40000)]))
    found: dict[str, list[str]] = {"a": list(string.ascii_letters[26:] + string.ascii_letters[:26]), "1": list(string.digits)}
    odd: list[str] = []
    others = {"a": regex.compile(r"\P{L}"), "1": regex.compile(r"\P{N}"), None: regex.compile(r"[\p{L}\p{N}]")}
    for _, (start, end) in split(every):
        run = every[start:end]
        joins = next((c for c in found if len(split(c + run[0])) == 1), None)
        if joins is not None:
            found[joins] += run
        odd += others[joins].findall(run)
    return CLASSES.format(letters=_ranges(found["a"]), numbers=_ranges(found["1"])), _ranges(odd)


class Recent:
    """What was looked up last, in two generations: what is used again outlives the change to a new one."""

    def __init__(self, size: int):
        self._size = size
        self.held: dict = {}
        self._old: dict = {}

    def missing(self, keys: set) -> set:
        """Keys that must be learned; those of the older generation become young again."""
        if len(self.held) > self._size:
            self._old, self.held = self.held, {}
        gone = keys.difference(self.held)
        back = gone.intersection(self._old)
        self.held.update((k, self._old[k]) for k in back)
        return gone - back


def split_pieces(text: str) -> list[str]:
    """Cut before each space that a non-space follows; the first piece carries a mark, the rest lost their space.

    The word pattern never matches across such a place: a match of non-spaces
    ends at white space, a run of white space leaves its last space to the
    word, and nothing looks behind.  So the pieces can be encoded apart.
    """
    parts = text.split(" ")
    if _BEFORE_SPACE.search(text):
        joined: list[list[str]] = [[parts[0]]]
        for part in parts[1:]:
            if not part or part[0].isspace():
                joined[-1].append(part)
            else:
                joined.append([part])
        parts = [" ".join(x) for x in joined]
    parts[0] = _NO_SPACE + parts[0]
    return parts


def unmarked(piece: str) -> str:
    """The text of a piece."""
    return piece[1:] if piece[:1] == _NO_SPACE else " " + piece


class Bpe:
    """A vocabulary with its merges; ``encode`` gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        letters = byte_letters()
        vocab = said["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (
            1 + max([*vocab.values(), *(t["id"] for t in said["added_tokens"])])
        )
        for token, number in vocab.items():
            self.token_bytes[number] = bytes(letters[c] for c in token)
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        for content, number in self.special.items():
            self.token_bytes[number] = content.encode()
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        made_at: dict[int, int] = {}
        for rank, merge in enumerate(said["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.ranks[left << ID_BITS | right] = rank
            self.merges.append((left, right, new))
            made_at.setdefault(new, rank)
            if max(made_at.get(left, -1), made_at.get(right, -1)) >= rank:
                raise ValueError("a merge uses a token that only a later merge makes")
        exact, odd = borders(path)
        self._word = regex.compile(PATTERN)
        self._exact = regex.compile(exact)
        self._odd = re.compile(f"[{odd}]" if odd else r"(?!)")
        self._special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self._words = Recent(CACHE_WORDS)

    # --- merging

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, through one pair occurrence index over all of them."""
        symbols: list[int] = []
        byte_ids = self.byte_ids
        for word in words:
            symbols.extend([byte_ids[b] for b in word])
            symbols.append(-1)  # no pair crosses it
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranked = self.ranks.get
        where: dict[int, list[int]] = defaultdict(list)
        for at, (a, b) in enumerate(pairwise(symbols)):
            if (rank := ranked(a << ID_BITS | b)) is not None:
                where[rank].append(at)
        active = list(where)
        heapify(active)
        while active:
            rank = heappop(active)
            positions = where.pop(rank)
            positions.sort()
            left, right, new = self.merges[rank]
            for at in positions:
                if symbols[at] != left or symbols[nxt := after[at]] != right:
                    continue  # a merge to its left or an earlier rank has taken part of it
                symbols[at] = new
                symbols[nxt] = -2
                after[at] = nxt = after[nxt]
                before[nxt] = at
                if (found := ranked(new << ID_BITS | symbols[nxt])) is not None:
                    if found not in where:
                        heappush(active, found)
                    where[found].append(at)
                at = before[at]
                if at >= 0 and (found := ranked(symbols[at] << ID_BITS | new)) is not None:
                    if found not in where:
                        heappush(active, found)
                    where[found].append(at)
        out: list[list[int]] = []
        own: list[int] = []
        for s in symbols:
            if s >= 0:
                own.append(s)
            elif s == -1:
                out.append(own)
                own = []
        return out

    # --- whole texts

    def _split(self, text: str, word: regex.Pattern) -> list[str]:
        """The words of a text, special strings among them."""
        if self._special.search(text) is None:
            return word.findall(text)
        found, at = [], 0
        for m in self._special.finditer(text):
            found += [*word.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return found + word.findall(text[at:])

    def _learn(self, words: set[str]) -> dict[str, bytes | None]:
        """Ids of words not met before; None for those with an odd character, whose texts must be split again."""
        found: dict[str, bytes | None] = {w: array("I", [self.special[w]]).tobytes() for w in words if w in self.special}
        plain = [w for w in words if w not in found]
        if self._odd.search("\n".join(plain)):
            found.update((w, None) for w in plain if self._odd.search(w))
            plain = [w for w in plain if w not in found]
        for word, ids in zip(plain, self.merge_words([w.encode() for w in plain]), strict=True):
            found[word] = array("I", ids).tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, encoded together."""
        plans = [self._split(text, self._word) for text in texts]
        used: set[str] = set()
        used.update(*plans)
        long = {w for w in used if len(w) > CACHE_CHARS}
        held = self._words
        if new := held.missing(used - long):
            held.held.update(self._learn(new))
        passing = self._learn(long) if long else {}
        odd = {w for w in used - long if held.held[w] is None} | {w for w, ids in passing.items() if ids is None}
        if odd:
            # What is odd is found again in its text, and split there with what stands beside it.
            again = [row for row, plan in enumerate(plans) if not odd.isdisjoint(plan)]
            for row in again:
                plans[row] = self._split(texts[row], self._exact)
            exact = set().union(*(plans[row] for row in again))
            passing |= self._learn_exact(exact.difference(w for w in used if w not in odd))
        if passing:
            known = {**{w: held.held[w] for w in used if w in held.held}, **passing}.__getitem__
        else:
            known = held.held.__getitem__
        return [b"".join(map(known, plan)) for plan in plans]

    def _learn_exact(self, words: set[str]) -> dict[str, bytes | None]:
        """Ids of words that the exact pattern has cut."""
        plain = [w for w in words if w not in self.special]
        merged = self.merge_words([w.encode() for w in plain])
        found: dict[str, bytes | None] = {w: array("I", ids).tobytes() for w, ids in zip(plain, merged, strict=True)}
        return found | {w: array("I", [self.special[w]]).tobytes() for w in words if w in self.special}

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian unsigned 32-bit bytes; bad UTF-8 gives replacement marks."""
        tokens = self.token_bytes
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return Bpe(path)


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``chars`` characters."""
    start, size, held = 0, 0, []
    for row, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield start, held
            start, size, held = row + 1, 0, []
    if held:
        yield start, held


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` per row: ids as little-endian unsigned 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start, texts in blocks(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(bpe.encode(texts), pa.binary())], ["id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(id, ids, text)`` for ``(id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [bpe.decode(i or b"") for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, text)`` per row, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start, texts in blocks(batch.column(1).to_pylist()):
                ids = bpe.encode(texts)
                decoded = pa.array([bpe.decode(i) for i in ids], pa.string())
                own = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.binary()), decoded], ["id", "ids", "text"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, ids binary, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of ``(id, ids, text)`` as ``decode`` gives it."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
