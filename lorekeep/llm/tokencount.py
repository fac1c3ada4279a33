"""Token counts, equal to the tokenizers library's, with overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets.  Two chunks are
spliced at a boundary that both have and that is proven stable: before a space
that a non-space follows, where the word pattern of byte-level BPE always ends
a match and starts the next one from the text ahead alone.  If an overlap holds
no such place (a text without spaces), it is widened, up to the whole rest.

Other documents are cut at the same places into pieces and these into words;
the library encodes each word that a worker has not met, and counts are looked
up.

Defined results: null texts count as empty (0 bytes, 0 tokens); special strings
inside texts count as the library's default has them, as one special token;
repeated rows are counted each; a null id is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, blocks, borders, split_pieces, unmarked

#: Documents of more characters are encoded in chunks of this size.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Pieces and words whose counts a Python worker remembers.
CACHE_PIECES = 400_000
CACHE_WORDS = 800_000

Encoded = tuple[list[int], list[int]]  # token ids, and the character at which each starts


def stable(text: str, at: int) -> bool:
    """Whether the encoding splits before ``at`` whatever stands to either side."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at + 1].isspace()


def spliced(text: str, encode: Callable[[str], Encoded], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Token ids of the whole text from encodings of overlapping chunks."""
    out: list[int] = []
    begin, own = 0, 0  # of the chunk, and of the part of it that is not yet spliced

    def at(start: int, end: int) -> Encoded:
        ids, starts = encode(text[start:end])
        return ids, [s + start for s in starts]

    ids, starts = at(0, min(len(text), chunk + overlap))
    end = min(len(text), chunk + overlap)
    while end < len(text):
        nxt, wide = begin + chunk, overlap
        while True:
            new_end = min(len(text), max(nxt + chunk, end) + overlap)
            new_ids, new_starts = at(nxt, new_end)
            both = set(starts).intersection(new_starts)
            # The last place in the overlap, with a character of the next word inside both chunks.
            cut = next((b for b in range(end - 2, nxt, -1) if b in both and stable(text, b)), None)
            if cut is not None or end == len(text):
                break
            wide *= 2
            end = min(len(text), end + wide)
            ids, starts = at(begin, end)
        if cut is None:
            break  # widened up to the end of the text
        out += ids[bisect_left(starts, own) : bisect_left(starts, cut)]
        begin, own, end, ids, starts = nxt, cut, new_end, new_ids, new_starts
    return out + ids[bisect_left(starts, own) :]


class Counter:
    """Counts for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for s in self._special for c in s):
            raise ValueError("special tokens with white space would cross the places at which texts are cut")
        exact, odd = borders(path)
        self._word = regex.compile(PATTERN)
        self._exact = regex.compile(exact)
        self._odd = re.compile(f"[{odd}]" if odd else r"(?!)")
        self._known: dict[str, int] = {}
        self._words: dict[str, int] = {}

    def encoded(self, text: str) -> Encoded:
        found = self._tokenizer.encode(text, add_special_tokens=False)
        return found.ids, [s for s, _ in found.offsets]

    def _learn(self, pieces: set[str]) -> None:
        odd = {p for p in pieces if self._odd.search(p)} if self._odd.search("".join(pieces)) else set()
        split = {p: (self._exact if p in odd else self._word).findall(unmarked(p)) for p in pieces}
        if len(self._words) > CACHE_WORDS:
            self._words.clear()
        known = self._words
        new = list({w for found in split.values() for w in found}.difference(known))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = self._tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update(zip(part, map(len, found), strict=True))
        for piece, found in split.items():
            self._known[piece] = sum([known[w] for w in found])

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plans: dict[int, list[str]] = {}
        for row, text in enumerate(texts):
            if len(text) > CHUNK_CHARS:
                out[row] = len(spliced(text, self.encoded))
            elif any(s in text for s in self._special):
                out[row] = len(self.encoded(text)[0])
            else:
                plans[row] = split_pieces(text)
        if len(self._known) > CACHE_PIECES:
            self._known.clear()
        if new := {p for plan in plans.values() for p in set(plan).difference(self._known)}:
            self._learn(new)
        known = self._known.__getitem__
        for row, plan in plans.items():
            out[row] = sum(map(known, plan))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for start, texts in blocks(batch.column(1).to_pylist()):
                counts = pa.array(counter.counts(texts), pa.int64())
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), counts], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    counted = source.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
