"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A text is cut by the tokenizer's pattern, and each piece starts as one symbol per byte.  A heap holds the
adjacent pairs that have a rank; the lowest rank, leftmost on ties, is merged again and again, and a linked list
keeps the neighbours.  The count of a piece is its bytes minus its merges.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are each counted; only the id and
text columns are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import settle

#: Fixed value: the pre-tokenizer's pattern, as the vocabulary file's library documents it for byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stay, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairMerger:
    """Counts of a byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str, remember: int = 300_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = {c: bytes([b]) for b, c in byte_symbols().items()}
        as_bytes = lambda s: b"".join(symbols[c] for c in s)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}
        self.remember = remember

    def piece(self, raw: bytes) -> int:
        n = len(raw)
        if n < 2:
            return n
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(n)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] is left else n
            if j >= n or parts[j] is not right:
                continue  # one side was merged meanwhile
            parts[i], parts[j] = left + right, None
            alive -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return alive

    def _plain(self, text: str) -> int:
        total, seen = 0, self.seen
        for piece in self.pattern.findall(text):
            count = seen.get(piece)
            if count is None:
                count = self.piece(piece.encode())
                if len(piece) <= 40:
                    if len(seen) >= self.remember:
                        seen.clear()
                    seen[piece] = count
            total += count
        return total

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each, as the library has it by default."""
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; one narrow pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [tool.count(t) if t else 0 for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    settle(docs.sparkSession)
    two = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, f"`{id_col}` {two.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
