"""Alignment of two tokenizers' tokens by a label for each byte.

A text is encoded by A (byte-level BPE) and B (pieces with byte fallback), and both give back the same bytes.  Each byte gets
a label: none, an A token ends here, a B token ends here, or both do.  A regular expression takes the spans up to each
both-label out of the label string; the labels counted in a span say how many tokens of A and of B form the group.  Inside a
span every label but none also ends a stretch that one A token and one B token share: these are the links.

1. One pass encodes the texts, aligns them and stores each row's counts, digest, distinct linked id pairs and how often each
   occurs.
2. A pair's count is the number of rows that hold it, added up over all rows; its A id's highest count marks the best pairs.
3. The stored rows look their pairs up: in a broadcast table if there are at most ``max_pairs`` pairs, else by a shuffled
   join of (row, pair), which gives the same rows.

Defined results: a null or empty text, and one that A or B don't give back byte by byte (a raw U+2581, characters that B's
normalisation changes), has no tokens: zeros and an empty digest; a text of any length is aligned whole; repeated rows
are rows each, in the counts as well; a null id stays; only the id and text columns are read; an empty table gives an empty
result.  A text on which A's faster library gives up is encoded by the vocabulary's own library.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import settle, stored

#: Labels of a byte.
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
_SPAN = re.compile(rb"[^\x03]*\x03")


class Side:
    """What alignment needs of a tokenizer's ids: their bytes, sizes and decimal strings with the sign that follows."""

    def __init__(self, tokens: list[bytes], inner: str, last: str):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.names = np.array([f"{i}{mark}".encode() for i in range(len(tokens)) for mark in (inner, last)])


def labels_of(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The label of each byte, from the places where tokens end (1-based)."""
    label = np.zeros(int(ends_a[-1]), np.uint8)
    label[ends_a - 1] = A_END
    label[ends_b - 1] |= B_END
    return label


def groups(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B tokens each group has."""
    stops = np.cumsum(np.fromiter(map(len, _SPAN.findall(label.tobytes())), np.int64)) - 1
    a, b = (np.cumsum(label & bit > 0)[stops] for bit in (A_END, B_END))
    return np.diff(a, prepend=0), np.diff(b, prepend=0)


def links(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in the sequences of A and B, of all tokens that share bytes."""
    stops = label[np.flatnonzero(label)]
    a, b = stops & A_END > 0, stops & B_END > 0
    return np.cumsum(a) - a, np.cumsum(b) - b


def written(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, a: Side, b: Side) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the groups in order."""
    group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    before_a, before_b = np.cumsum(size_a), np.cumsum(size_b)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[before_a - 1] = last_b[before_b - 1] = 1
    out = np.zeros(len(ids_a) + len(ids_b), max(a.names.dtype, b.names.dtype))
    out[np.arange(len(ids_a)) + (before_b - size_b)[group_a]] = a.names[2 * ids_a + last_a]
    out[np.arange(len(ids_b)) + before_a[group_b]] = b.names[2 * ids_b + last_b]
    return out.tobytes().translate(None, b"\x00")[:-1]


class Aligner:
    """A byte-level BPE (its JSON and ranks files) against a piece vocabulary with byte fallback."""

    def __init__(self, spec_path: str, ranks_path: str, model_path: str):
        import sentencepiece
        import tiktoken

        from heddle.llm.token_counts import PATTERN

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.spec_path = spec_path
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_id = {rank: token for token, rank in ranks.items()}
        self.a = Side([by_id.get(i, b"") for i in range(max(by_id) + 1)], ",", "|")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.pieces.get_piece_size()
        self.b = Side([bytes([int(p[1:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(size))], ",", ";")

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, disallowed_special=())
        except ValueError:
            tool = _own_library(self.spec_path)
            return tool.encode(text, add_special_tokens=False).ids

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where a text has no tokens by definition."""
        if not text:
            return None
        a, b = self.encode_a(" " + text), self.pieces.encode(text, num_threads=1)
        raw = b" " + text.encode()
        if b"".join(map(self.a.tokens.__getitem__, a)) != raw or b"".join(map(self.b.tokens.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, text: str | None) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs (A id times B's number of ids, plus B id), times."""
        found = self.tokens(text)
        if found is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = found
        label = labels_of(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]))
        size_a, size_b = groups(label)
        at_a, at_b = links(label)
        pairs, times = np.unique(a[at_a] * len(self.b.tokens) + b[at_b], return_counts=True)
        digest = hashlib.sha256(written(a, b, size_a, size_b, self.a, self.b)).hexdigest()
        return len(a), len(b), len(size_a), len(at_a), digest, pairs, times


@lru_cache(maxsize=1)
def _own_library(spec_path: str):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(spec_path)
    tool.encode_special_tokens = True
    return tool


@lru_cache(maxsize=1)
def aligner(spec_path: str, ranks_path: str, model_path: str) -> Aligner:
    return Aligner(spec_path, ranks_path, model_path)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, spec_path: str, ranks_path: str, model_path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row."""
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [*_COUNTS, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(spec_path, ranks_path, model_path)
        for batch in batches:
            for at in range(0, len(batch), 100):  # keeps what a step holds small
                part = batch.slice(at, 100)
                columns = list(zip(*map(tool.align, part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many rows hold the pair, and whether no other pair of its A id is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.expr(f"pair div {size_b}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _by_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds n_best and count_sum; the caller has checked the size of counts."""
    known = counts.orderBy("pair").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in rows.columns if c not in ("pairs", "times", "row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times")).flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy()
            spot = np.searchsorted(pair, lists.flatten().to_numpy())
            edges = np.append(0, np.cumsum(sizes))
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[edges])  # noqa: B023, E731
            values = [total(times * best[spot]), total(times * n[spot])] if len(pair) else [np.zeros(len(batch), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(v, pa.int64()) for v in values)], names=[*kept, "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def _by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a shuffle of (row, pair)."""
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select(*(c for c in rows.columns if c not in ("pairs", "times", "row")), zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, spec_path: str, ranks_path: str, model_path: str, max_pairs: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    import sentencepiece

    settle(docs.sparkSession)
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    rows = stored(aligned(docs, spec_path, ranks_path, model_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(rows, size_b))
    out = _by_broadcast(rows, counts) if counts.count() <= max_pairs else _by_join(rows, counts)
    return out.select(F.col("id").alias(id_col), *_COUNTS, "n_best", "count_sum", "groups_sha256")
