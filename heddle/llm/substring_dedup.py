"""Substring dedup with suffix automata: words inside a window that an earlier document has as well are removed.

A window is ``size`` consecutive words.  A document loses every word covered by a window whose word sequence also
starts in a document with a smaller id; windows are judged on the input.

1. Every window names one of its ``size // 2``-word runs, the one whose hash is lowest.  Equal windows name equal runs,
   so windows can be gathered by that name.  Neighbouring windows with one name are a segment: about one row for
   thirteen words.
2. Names that only one document has are dropped, most of them where they lie (``common.having``); exactly equal segments
   of several documents become one row with the smallest id.  All later copies of such a segment are covered as a whole.
   Equal means equal names and equal hashes, 62 bits each, of which the hash spans all words.
3. Reference shards: the different segments of the remaining names, dealt by name, so that everything that can match
   meets in one shard.  A shard is at most ``shard_words`` words, or one name.  Its suffix automaton carries the smallest
   id of each state; streaming the segments through it gives, for every position, the longest match, and by following
   suffix links to the state of exactly ``size`` words, the smallest document with that window.
4. A name with over ``hot`` different segments (a common passage in thousands of contexts) would make a shard without
   bound.  Its windows are keyed by the whole window instead, where a smallest id is an aggregate.
5. The covered windows of each document are collected by id, and the words under them are dropped.  Only texts that may
   have any (``common.likely``) are shuffled for that; for step 3 no whole text is, only segments.

The whole corpus is its own reference, which has no size bound; so shards are not broadcast to all tasks, as one would
with a fixed reference set, but each meets only what can match in it.

Defined results: a null or empty text has no words; rows with a null id neither remove nor lose words; rows that share an
id don't remove each other's words; only the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Rolling, by_ids, hash_texts, having, in_slots, likely, map_columns, meet, settle, signed, sliding, slot_bits, stored


class Segments:
    """The segments of one text, from its word hashes: name and hash of each, and the windows [start, end) that it stands for."""

    def __init__(self, hashes: np.ndarray, size: int):
        gram = max(1, size // 2)
        self.rolling, self.size = Rolling(hashes), size
        names = sliding(self.rolling.grams(gram), size - gram + 1, np.minimum)
        cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
        self.start, self.end = np.r_[0, cuts], np.r_[cuts, len(names)]
        self.name = signed(names[self.start])
        self.hash = signed(self.rolling.ranges(self.start, self.end + size - 1))

    def windows(self, k: int) -> np.ndarray:
        starts = np.arange(self.start[k], self.end[k])
        return signed(self.rolling.ranges(starts, starts + self.size))


def all_segments(texts: list[bytes | None], size: int) -> list[Segments | None]:
    """Of each text; None where there are too few words for a window."""
    hashes, offsets = hash_texts(texts)
    return [Segments(hashes[a:b], size) if b - a >= size else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


class SuffixAutomaton:
    """Of several word sequences; every state knows the smallest owner of the texts that end there."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.owner.append(None)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the part of q that p's texts and ``word`` make."""
        clone = self._state(self.length[p] + 1)
        self.next[clone] = self.next[q].copy()
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words, owner: int) -> None:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(length[last] + 1), last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if owners[last] is None or owner < owners[last]:
                owners[last] = owner

    def settle(self) -> None:
        """Passes owners down the suffix links; once, after the last text."""
        owners, link = self.owner, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up, own = link[s], owners[s]
            if up > 0 and own is not None and (owners[up] is None or own < owners[up]):
                owners[up] = own

    def statistics(self, words) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state = have = 0
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                have = length[state]
            if word in nxt[state]:
                state, have = nxt[state][word], have + 1
            yield have, state

    def first_owner(self, state: int, size: int) -> int:
        """Smallest owner of the last ``size`` words of a match of at least that length."""
        link, length = self.link, self.length
        while length[link[state]] >= size:
            state = link[state]
        return self.owner[state]


def _shard(rows: list[tuple[int, int, bytes]], size: int) -> Iterator[tuple[int, int, bytes]]:
    """(id, segment, covered windows) for segments (hash, id, text) of which a smaller document has a window."""
    automaton, texts = SuffixAutomaton(), [text.split() for _, _, text in rows]
    for (_, owner, _), words in zip(rows, texts, strict=True):
        automaton.add(words, owner)
    automaton.settle()
    for (key, owner, _), words in zip(rows, texts, strict=True):
        covered = [have >= size and automaton.first_owner(state, size) < owner for have, state in automaton.statistics(words)][size - 1 :]
        if any(covered):
            yield owner, key, bytes(covered)


def coverage(docs: DataFrame, size: int = 50, hot: int = 1000, shard_words: int = 20_000, small: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, mask): per document, segments or windows (by hash) that lie in smaller documents; a null mask means all of it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("id is not null")

    def cut_up(ids, texts):
        parts = [(i, s) for i, s in zip(ids, all_segments(texts, size), strict=True) if s]
        if not parts:
            return None
        return np.concatenate([s.name for _, s in parts]), np.concatenate([s.hash for _, s in parts]), np.repeat(np.array([i for i, _ in parts], np.int64), [len(s.name) for _, s in parts])

    three = ("name long, key long, id long", [pa.int64()] * 3, ["name", "key", "id"])
    found = map_columns(rows, cut_up, *three)
    shared = stored(found.groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("name"))
    # most segments have a name of their own; these don't move again
    uses = stored(having(found, shared, "name", small, most=28).distinct())
    firsts = stored(uses.groupBy("name", "key").agg(F.min("id").alias("id"), F.count("*").alias("uses")))
    sizes = stored(firsts.groupBy("name").count().where("count > 1"))
    busy = stored(sizes.where(F.col("count") > hot).select("name"))
    is_busy = lambda df, how: df.join(busy, "name", how)

    # later copies of a whole segment
    copied = firsts.where("uses > 1").withColumnRenamed("id", "lo")
    later = meet(uses, copied, ["name", "key"], "uses").where("id > lo").select("id", "key", F.lit(None).cast("binary").alias("mask"))

    # different segments of one name, through the automata; a name with one segment has nothing else to match
    several = sizes.where(F.col("count") <= hot).select("name")
    wanted = stored(having(firsts, several, "name", small).select("name", "key", "id"))
    filled, low = slot_bits(wanted.select(F.col("key").bitwiseXOR(F.col("id"))), 28)

    def texts_of(ids, texts):
        out = []
        for i, text, part in zip(ids, texts, all_segments(texts, size), strict=True):
            at = np.flatnonzero(in_slots(filled.value, (part.hash ^ i) & low)).tolist() if part else []
            words, done = text.split() if at else [], set()
            for k in at:
                if part.hash[k] not in done:
                    done.add(part.hash[k])
                    out.append((int(part.name[k]), int(part.hash[k]), i, b" ".join(words[part.start[k] : part.end[k] + size - 1])))
        return list(zip(*out, strict=True)) if out else None

    # segments are cut where the texts lie; a few too many, so each wanted one has a row without text that goes before it
    segments = map_columns(rows.where(likely(wanted, "id")("id")), texts_of, "name long, key long, id long, text binary", [*[pa.int64()] * 3, pa.binary()], ["name", "key", "id", "text"])
    shards = wanted.withColumn("text", F.lit(None).cast("binary")).unionByName(segments)
    dealt = shards.repartition("name").sortWithinPartitions("name", "id", "key", F.col("text").asc_nulls_first()).select("name", "key", "id", "text")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, words, due = [], None, 0, None
        done: list[tuple] = []
        for batch in batches:
            for own, key, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    due = own, key, i
                    continue
                if due != (own, key, i):
                    continue
                if own != name and words >= shard_words:
                    done += _shard(held, size)
                    held, words = [], 0
                    if len(done) > 10_000:
                        yield emit(done)
                        done = []
                name = own
                held.append((key, i, text))
                words += text.count(b" ") + 1
        done += _shard(held, size)
        yield emit(done)

    def emit(done: list[tuple]) -> pa.RecordBatch:
        i, key, mask = zip(*done, strict=True) if done else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(key, pa.int64()), pa.array(mask, pa.binary())], names=["id", "key", "mask"])

    partial = dealt.mapInArrow(match, "id long, key long, mask binary")

    # names in very many contexts: by whole windows
    if busy.isEmpty():
        return later.union(partial)
    where = stored(is_busy(uses, "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys")))

    def windows_of(ids, texts, keys):
        out_id, out_name, out_key = [], [], []
        for i, part, want in zip(ids, all_segments(texts, size), keys, strict=True):
            want = set(want)
            for k in range(len(part.name)) if part else ():
                if int(part.hash[k]) in want:
                    out_key.append(part.windows(k))
                    out_id.append(np.full(len(out_key[-1]), i, np.int64))
                    out_name.append(np.full(len(out_key[-1]), part.name[k], np.int64))
        return (np.concatenate(out_name), np.concatenate(out_key), np.concatenate(out_id)) if out_id else None

    windows = stored(map_columns(by_ids(rows, where, "id", "inner", small // 2, "keys"), windows_of, *three).distinct())
    least = stored(windows.groupBy("name", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("uses")).where("lo < hi"))
    single = meet(windows, least.drop("hi"), ["name", "key"], "uses").where("id > lo").select("id", "key", F.lit(None).cast("binary").alias("mask"))
    return later.union(partial).union(single)


def remove(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row; ``keep_text`` gives all columns of docs instead, with the text's words
    that stay joined by one space (a text that loses nothing stays as it is)."""
    settle(docs.sparkSession)
    covered = coverage(docs, size, id_col=id_col, text_col=text_col, **options)
    # a document's list is at most as long as the document
    lists = stored(covered.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("key", "mask")).alias("__covered")))
    # only documents that may have a list move to meet it; the others are done where they lie
    listed = likely(lists, "__id")(F.col(id_col))
    docs_in = docs if keep_text else docs.select(id_col, text_col)
    met = docs_in.where(listed).withColumn("__at", F.col(id_col).cast("long"))
    met = met.join(lists, F.col("__at") == F.col("__id"), "left").drop("__id", "__at")
    others = docs_in.where(~listed)

    def left(text: bytes | None, marks) -> tuple[list[bytes], int, bool]:
        words = text.split() if text else []
        if not marks or len(words) < size:
            return words, len(words), False
        part, whole, masks = all_segments([text], size)[0], set(), {}
        for mark in marks:
            if mark["mask"] is None:
                whole.add(mark["key"])
            else:
                masks[mark["key"]] = np.frombuffer(mark["mask"], bool)
        gone = np.zeros(len(words) + 1, np.int64)
        starts = np.zeros(int(part.end[-1]), bool)
        for k, key in enumerate(part.hash.tolist()):
            a, b = part.start[k], part.end[k]
            if key in whole:
                starts[a:b] = True
            elif key in masks:
                starts[a:b] |= masks[key]
        if whole:  # also windows, wherever the text has them; a one-window segment has the hash of its window
            at = np.arange(len(starts))
            starts |= np.isin(signed(part.rolling.ranges(at, at + size)), np.fromiter(whole, np.int64, len(whole)))
        at = np.flatnonzero(starts)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + size, -1)
        keep = np.cumsum(gone[:-1]) == 0
        return [w for w, k in zip(words, keep.tolist(), strict=True) if k], len(words), True

    schema = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            texts, covered_by = batch.column(1).to_pylist(), batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(batch)
            for text, marks in zip(texts, covered_by, strict=True):
                words, total, _ = left(text, marks)
                n.append(total)
                removed.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    if not keep_text:
        text, result = F.col(text_col).cast("string").cast("binary").alias("text"), f"`{id_col}` {schema}, n_words long, n_removed long, kept_sha256 string"
        return met.select(id_col, text, "__covered").mapInArrow(digest, result).union(others.select(id_col, text).mapInArrow(digest, result))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            texts = []
            for text, marks in zip(batch.column(text_col).to_pylist(), batch.column("__covered").to_pylist(), strict=True):
                words, total, touched = left(text.encode() if text else None, marks)
                texts.append(b" ".join(words).decode() if touched and len(words) < total else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names], names=names)

    return met.mapInArrow(rewrite, docs.schema).union(others)
