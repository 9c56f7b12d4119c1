"""The ten operators against brute-force versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL

pytest.importorskip("public_tokenizers")

BASE = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()[i % 20] + str(i % 7) for i in range(120)]
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [
    (1, " ".join(BASE)),
    (2, " ".join(BASE)),
    (3, " ".join([*BASE[:60], "changed", *BASE[61:]])),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, "one two"),
    (8, "One TWO"),
    (9, LONG),
    (10, "x y z " + LONG + " tail"),
    (11, " ".join(["same"] * 400)),
    (12, " ".join(["same"] * 380)),
    (13, "ünïcode wörds " + " ".join(BASE[:55])),
    (2, " ".join(BASE)),
    (None, " ".join(BASE)),
    (14, "a b c d e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with inner ones
    rows = [(i, t, "src/a" if i and i % 2 else None, 0, "k", 1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, token string, id double")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def all_docs(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def words(text):
    return (text or "").encode().split()


def brute_dedup(texts, size=50):
    """Per input row: kept words and number removed."""
    first = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in texts:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(spark, docs, nothing, hot):
    from heddle.llm.substring_dedup import remove

    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in remove(docs, hot=hot).collect()), key=key)
    assert got == sorted(brute_dedup(TEXTS), key=key)
    real = [(r.doc_id, r.text) for r in all_docs(spark).collect()]
    assert sorted(map(tuple, remove(all_docs(spark), hot=hot, small=0 if hot == 1 else 2_000_000).collect())) == sorted(brute_dedup(real))
    assert remove(nothing).count() == 0
    kept = remove(docs, keep_text=True)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


@pytest.mark.parametrize("keep_text", [False, True])
def test_substring_dedup_of_one_window_at_several_places(spark, keep_text):
    """A common passage that is a segment of its own at a text's start (or end) and stands inside longer segments, too."""
    from heddle.llm.substring_dedup import remove

    size, rng = 6, np.random.default_rng(0)
    some = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for p in range(30):
        passage = some(size)
        texts += [(10 * p + k, " ".join([*some(9), *passage, *some(9)])) for k in range(5)]
        texts += [(10 * p + 5, " ".join([*passage, *some(9), *passage, *some(9)])), (10 * p + 6, " ".join([*some(9), *passage, *some(9), *passage]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(brute_dedup(texts, size))
    got = remove(df, size, hot=1, keep_text=keep_text)
    if keep_text:
        assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()) == [(i, sha) for i, _, _, sha in want]
    else:
        assert sorted(map(tuple, got.collect())) == want


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    context, gateway = spark._jsparkSession.sparkContext(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("keep_text", [False, True])
def test_substring_dedup_moves_only_texts_with_marks(spark, keep_text):
    """Two of 400 long texts share a passage: joins by shuffle move these two, not the corpus."""
    from heddle.llm.substring_dedup import remove

    rng = random.Random(0)
    some = lambda n: ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(n)]
    passage = some(60)
    texts = [(i - 200, " ".join([*some(100), *(passage if i in (7, 390) else []), *some(100)])) for i in range(400)]
    texts.append((None, texts[7][1]))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_dedup(texts)
    assert [i for i, _, gone, _ in want if gone] == [190]
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before, start = spark.conf.get(conf), shuffled(spark)
    spark.conf.set(conf, "-1")
    try:
        got = remove(df, keep_text=keep_text, small=0).collect()
    finally:
        spark.conf.set(conf, before)
    moved, size = shuffled(spark) - start, sum(len(t) for _, t in texts)
    if keep_text:
        assert sorted((str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == sorted((str(i), sha) for i, _, _, sha in want)
    else:
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert moved < size / 2


@pytest.mark.parametrize("most", [26, 10, 6])
def test_likely(spark, most):
    """No id of the table fails, whatever the size of the set; with enough slots nearly all others do."""
    from heddle.llm.common import likely

    ids = spark.range(-3000, 3000, 7).unionByName(spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "id long"))
    others = spark.range(10_000, 20_000)
    for table in (ids, ids.where("false")):
        test = likely(table, "id", most)
        assert table.where(~test("id")).count() == 0
        wrong = others.where(test(F.col("id"))).count()
        assert wrong <= (500 if table is ids and most == 26 else 0 if table is not ids else 10_000)
        assert spark.createDataFrame([(None,)], "id long").where(test("id").isNull()).count() == 0


def test_words_that_collide_modulo_powers_of_two(spark):
    """Two documents that differ in one structured word of 1,024 letters share no window and no shingle with it."""
    from heddle.llm.jaccard_join import join
    from heddle.llm.substring_dedup import remove
    from tests.llm.test_properties import thue_morse

    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    line = [f"w{k}" for k in range(81)]
    texts = [(1, " ".join([*line[:41], one, *line[41:80]])), (2, " ".join([*line[:41], two, *line[41:80]])), (3, f"A {one}"), (4, f"A {two}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, remove(df).collect())) == brute_dedup(texts)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in join(df, 4, 85, 100).collect()) == brute_join(texts, 4, 85, 100)


@pytest.mark.parametrize("small", [500_000, 3, 0])
def test_meet(spark, small):
    """Hot keys are broadcast, others meet in a shuffle; the rows are those of one join."""
    from heddle.llm.common import meet

    rows = [(k, 5000 if k == 3 else k) for k in range(9)]
    df = spark.range(6000).select(F.when(F.col("id") < 5000, 3).otherwise(F.col("id") % 9).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k int, id long"))
    table = spark.createDataFrame([(k, n, f"t{k}") for k, n in rows if k != 5], "k int, n long, t string")
    for how in ("inner", "left"):
        want = df.join(table.drop("n"), ["k"], how)
        got = meet(df, table, ["k"], "n", how, max(1, small))
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def brute_join(texts, n, num, den):
    sets = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets if i is not None)


@pytest.mark.parametrize(("n", "num", "light", "block", "heavy"), [(4, 85, 50, 1_000_000, 500_000), (5, 80, 1, 2000, 500_000), (1, 50, 2, 1000, 5)])
def test_jaccard_join(spark, docs, nothing, n, num, light, block, heavy):
    from functools import partial

    from heddle.llm.jaccard_join import join

    join = partial(join, max_heavy=heavy)

    got = join(docs, n, num, 100, light=light, block=block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect() if r.doc_id is not None) == brute_join(TEXTS, n, num, 100)
    assert got.count() == len(TEXTS)
    if n != 1:
        real = [(r.doc_id, r.text) for r in all_docs(spark).collect()]
        out = join(all_docs(spark), n, num, 100, light=light, block=block).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_join(real, n, num, 100)
    assert join(nothing).count() == 0


def test_overlaps_blocked():
    from heddle.llm.jaccard_join import overlaps

    rng = np.random.default_rng(0)
    left, right = ([np.unique(rng.integers(0, 300, k)).astype(np.uint64) for k in rng.integers(1, 200, 30)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert overlaps(left, right, width=17).tolist() == want


def test_components(spark):
    from heddle.llm.common import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150)) and got[200] == got[201] == 200 and len(got) == 93
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    # in one share of edges or in many: a chain, a star, random links, repeated edges, negative ids, nulls
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(-300, 0)] + [(900, k) for k in range(901, 1100)] * 2 + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(600)] + [(None, 3), (4, None)]
    root: dict[int, int] = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            mine, other = root.get(a, a), root.get(b, b)
            for x in {a, b} | {x for x, r in root.items() if r in (mine, other)}:
                root[x] = min(mine, other)
    table = spark.createDataFrame(edges, "a long, b long")
    for held in (7, 150, 200_000):
        rows = [tuple(r) for r in components(table, held=held).collect()]
        assert sorted(rows) == sorted(root.items()), held


def test_token_counts(spark, docs, nothing):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from heddle.llm.token_counts import merger, token_counts

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    odd = ["<|endoftext|>x <|endoftext|><|endof", "aaaa" * 900, "\x1c\x85\xa0　 ​ x", "\r\n \n\n a", "don't DON'T 12 345²", "\U0001f600" * 30, "́́", *(f"a {chr(c)} {chr(c)}{chr(c)}b1" for c in range(1, 0x3100, 7))]
    assert [t for t in odd if merger(path).count(t) != count(t)] == []
    got = token_counts(docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((i, len((t or "").encode()), count(t), count(t) > 1024) for i, t in TEXTS)
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts(nothing, path).count() == 0


def test_packing(docs, nothing):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from heddle.llm.packing import binary_lengths, encoder, pack

    paths = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(paths[0])
    rows = pack(docs, *paths, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)
    by_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
    for i, t in TEXTS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for j, _ in TEXTS if j == i)
        parts = sorted(by_doc[i], key=lambda r: r.start)[::copies]
        assert [x for r in parts for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in parts)
    assert binary_lengths(3000) == [1024, 1024, 512, 256, 128, 32, 16, 8] and binary_lengths(1) == [1]
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000):
        assert encoder(*paths)(text) == library.encode(text, add_special_tokens=False).ids
    long = docs.sparkSession.createDataFrame([(1, " " * 1_000_000, 7, "b")], "doc_id long, text string, sequence_id int, bucket string")
    assert [tuple(r) for r in pack(long, *paths).groupBy("doc_tokens").agg(F.sum("length")).collect()] == [(1_000_001, 1_000_001)]
    assert encoder(*paths)("<|endoftext|>a") == library.encode("<|endoftext|>a", add_special_tokens=False).ids
    assert pack(nothing, *paths).count() == 0
    with pytest.raises(ValueError):
        pack(docs, *paths, capacity=1000)


def test_license_scan(spark, nothing):
    from heddle.llm.licenses import scan

    texts = [
        (1, "All Rights reserved. (c) CC-BY cc by"), (2, None), (3, ""), (4, "general public license general public license"), (5, "released under the MIT License."), (6, "mit mit license rights reserved all"),
        (7, "CC BY CC BY-NC 4.0"), (8, "the GNU Lesser General\nPublic License v3"), (9, "ALL RIGHTS RESERVED " * 50), (9, "x"), (None, "cc by"), (10, "Kind of ccé by"), (11, "license " * 300),
    ]
    got = {(r.doc_id, r.n_words): r for r in scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        spots = [(k, name) for p, name in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(spots), min((k for k, _ in spots), default=None), max((k for k, _ in spots), default=None))
        assert r.base_labels == ",".join(sorted({n for _, n in spots})) and 0 <= r.score <= 1
    long = {1: "cc by nc " * 120_000, 2: "general public license version 2 " * 30_000, 3: "license " * 200_000, 4: "rights all reserved " * 60_000}
    df = spark.createDataFrame([(i, t, 7, "w") for i, t in long.items()], "doc_id long, text string, words int, open string")
    seen = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.n_places) for r in scan(df).collect()}
    assert seen == {1: (360_000, 120_000, 0, 359_997, "cc-by,cc-by-nc", 240_000), 2: (150_000, 30_000, 0, 149_995, "gpl,gpl-2.0", 60_000), 3: (200_000, 0, None, None, "", 0), 4: (180_000, 0, None, None, "", 0)}
    assert got[5, 5].labels == "mit" and got[7, 7].labels == "cc-by,cc-by-nc" and got[8, 7].labels == "gpl,lgpl" and got[6, 6].labels == "mit"
    assert scan(nothing).count() == 0


def test_chat(spark):
    from heddle.llm.chat import digest, reconstruct, render

    tricky = "\\### Assistant: </turn> ok \\b\\l\\h <\\turn>"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", tricky), (1, 2, "assistant", None), (2, 0, None, tricky), (2, 0, "user", ""), (3, 5, "a: b\\c:", "x\n</turn>\n### "), (3, 4, "assistant", "### a"), (None, 0, "user", "n"), (4, 0, "user", "r"), (4, 0, "user", "r"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.col("turn"), "kind": F.lit("message")})
    got = {r.conv_id: r for r in digest(render(reconstruct(df))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert digest(render(reconstruct(df.where("false")))).count() == 0


def test_chat_events(spark):
    from heddle.llm.chat import reconstruct

    events = [
        (1, "u1", 1, "message", "user", "hello"), (1, "x2", 2, "message", "assistant", ""), (1, "x2", 3, "delta", "assistant", "old"), (1, "x2", 5, "regenerate", "assistant", "ne"), (1, "x2", 6, "delta", "assistant", "w"),
        (1, "x3", 7, "delta", "user", "stream"), (1, "x3", 8, "delta", "user", "ed"), (1, "u1", 9, "edit", "user", "hello!"), (1, "x4", 10, "message", "assistant", "gone"), (1, "x4", 11, "delete", "assistant", ""),
    ]
    # a later message may have a smaller key; a repeated row, events of one number, deltas without or after anything, odd kinds, nulls
    events += [
        (2, "z9", 1, "message", "user", "first"), (2, "a1", 2, "message", "assistant", "sec"), (2, "a1", 3, "delta", None, "ond"), (2, "a0", 2, "message", "assistant", "zz"),
        (3, "m", 1, "delta", "assistant", "x"), (3, "m", 2, "delete", None, None), (3, "m", 3, "delta", "assistant", "y"), (3, "m", 4, "delta", "assistant", None), (3, "m", 5, "delta", "assistant", "z"), (3, "n", 9, "edit", "user", "only"), (3, "o", 10, "odd", "user", "q"), (3, "p", 11, "delete", "user", ""),
        (4, "m", 1, "message", "user", "r"), (4, "m", 1, "message", "user", "r"), (4, "m", 1, "delta", "user", "+"), (4, None, None, None, None, None), (None, "m", 1, "message", "user", "n"),
    ]
    df = spark.createDataFrame([(*e, 0) for e in events], "conv_id long, turn string, seq long, kind string, role string, text string, first int")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in reconstruct(df).collect()}
    assert got == {
        1: [("user", "hello!"), ("assistant", "new"), ("user", "streamed")], 2: [("user", "first"), ("assistant", "second"), ("assistant", "zz")],
        3: [("assistant", "yz"), ("user", "only"), ("user", "q")], 4: [("", ""), ("user", "r"), ("user", "r+")], None: [("user", "n")],
    }
    many = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.lit("m").alias("turn"), F.col("id").alias("seq"), F.lit("delta").alias("kind"), F.lit("assistant").alias("role"), F.format_string("%d ", "id").alias("text"))
    assert reconstruct(many).collect()[0].messages[0].text == "".join(f"{k} " for k in range(20_000))


def test_chat_log(spark):
    """The query's log gives the turns back, repeated and equal turns included."""
    from heddle.llm.chat import reconstruct
    from heddle.llm.queries import turn_log

    rows = [(1, 0, "user", "abc"), (1, 1, "assistant", "x\U0001f600y"), (1, 2, "assistant", None), (1, 3, None, "q"), (2, 0, "user", "r"), (2, 0, "user", "r"), (2, 0, "user", "a"), (2, 0, "assistant", "z"), (3, 5, "user", ""), (3, 4, "user", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in reconstruct(turn_log(df)).collect()}
    assert got == {c: [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))] for c in (1, 2, 3)}


def test_top_k(spark):
    from heddle.llm.topk import top_k

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 2)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 8) for i in range(9)] + [(50, None), (300, [1.0, None]), (301, [float("nan")] * 8), (302, [float("inf")] * 8), (350, [1.0, 2.0]), (400, [0.0] * 8), (400, [0.0] * 8), (150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int".replace(", label int", ""))
    good = [(i, np.floor(256 * np.array(np.array(v, np.float32), float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    pad = lambda v: np.pad(v, (0, 8 - len(v)))
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = pad(next(v for i, v in good if i == q))
        best = sorted((-int(own @ pad(v)), i) for i, v in good if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard in (8192, 16):
        assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, page=4).collect())) == want
    assert top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def clusters(rng, dims=16, size=400):
    centres = rng.normal(size=(10, dims)) * 300
    return np.vstack([rng.normal(c, 20, (size, dims)) for c in centres]).astype(np.int64)


def test_m_tree_cuts_off():
    from heddle.llm.topk import MTree

    v = clusters(np.random.default_rng(0))
    tree = MTree(np.arange(len(v)), v, 16)
    asked = np.arange(0, len(v), 97)
    got = defaultdict(list)
    for q, i, s in tree.search(asked, v[asked], 5):
        got[q].append((-s, i))
    for at, q in enumerate(asked):
        assert got[at] == sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
    assert tree.computed < 0.6 * len(asked) * len(v)


def test_top_k_sends_queries_only_where_their_bound_allows(spark):
    from heddle.llm.topk import routes, top_k

    v = clusters(np.random.default_rng(2))
    rows = [(i, [x / 256 for x in row]) for i, row in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x * 256).cast("long")).alias("v"), (F.col("vec_id") % 50 == 0).alias("q"))
    mine, each = routes(whole, 5, 64)
    seen = each.join(mine.groupBy("shard").count(), "shard").agg(F.sum("count")).first()[0]
    asked = len(v) // 50
    assert seen < 0.6 * asked * len(v)
    want = [(q, k + 1, i, -s) for q in range(0, len(v), 50) for k, (s, i) in enumerate(sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5])]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, shard_rows=64, page=16).collect())) == want


def test_decontamination(spark, nothing):
    from heddle.llm.decontaminate import clean, find_leaks, tiles

    item = "the quick brown fox jumps over the lazy dog and then it sleeps until noon before running home again"
    a, b = item.split()[:9], item.split()[9:]
    texts = [
        (1, f"intro words here {item} and more"), (2, "Some " + " ".join(b) + " middle part " + " ".join(a) + "."), (3, " ".join(a[:6]) + " nothing else of it"), (4, item.upper().replace(" ", ", ")), (5, None), (6, ""), (7, "unrelated text about other things"), (1, item), (None, item), (8, "tiny item"), (9, (item + " ") * 40),
    ]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, item string")
    items = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "tiny item"), (14, "!!!")], "item_id long, text string")
    for words_ in (2_000_000, 1):
        got = find_leaks(docs, items, block_words=words_).collect()
        assert sorted(((r.doc_id or 0), r.item_id) for r in got) == [(0, 10), (1, 10), (1, 10), (2, 10), (4, 10), (8, 13), (9, 10)]
    assert {r.n_tiles for r in got if r.doc_id == 2} == {2}
    assert sorted(str(r.doc_id) for r in clean(docs, find_leaks(docs, items)).collect()) == ["3", "5", "6", "7", "None"]
    assert find_leaks(nothing, items).count() == 0 and find_leaks(docs, items.where("false")).count() == 0
    assert sorted(n for _, _, n in tiles([1, 2, 3, 4, 5, 6, 7, 8], [5, 6, 7, 8, 9, 1, 2, 3, 4], 2)) == [4, 4]


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><a href="/">Home</a></header><nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav>
<div class="cookie-notice">We use cookies {n}</div><aside>Side {n}</aside><article><h1>Head {n} &amp; co</h1><p>First <b>bo</b>ld&nbsp;{n}<br>line<p>Second &lt;tag&gt; {m}</p>{more}<form><input> Sign up</form><div class="comments"><p>Nice {n}</p></div></article>
<!-- ad --><div class="ad">Buy {n}</div><footer>&copy; {n}</footer>"""


def test_html_extraction(spark):
    from heddle.llm.html_extract import extract

    rows = [(n, f"https://h{n % 3}.example.com/p/{n}", PAGE.format(n=n, m=n * 7, more="<ul><li>item</ul>" if n % 2 else "")) for n in range(24)]
    rows += [(100, None, None), (101, "https://h0.example.com/", ""), (102, "nohost", "<p>Only <i>this</i> para &#8212; here"), (3, *rows[3][1:])]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "page_id long, url string, html string, wrapper string, host int")
    for limit in (1 << 25, -1):
        got = extract(df, broadcast_bytes=limit).collect()
        assert len(got) == len(rows)
        text = {r.page_id: r.text for r in got}
        for n in range(24):
            assert text[n] == f"Head {n} & co First bold {n} line Second <tag> {n * 7}" + (" item" if n % 2 else "")
        assert text[100] == "" and text[101] == "" and text[102] == "Only this para — here"
        assert all(r.n_chars == len(r.text) for r in got)
    assert extract(df.where("false")).count() == 0


LAYOUTS = {
    "article": ("<nav><a href='/'>Home</a></nav><article><h1>A {n}</h1><p>Body {n}</p></article>", "A {n} Body {n}"),
    "main": ("<nav><a href='/'>Home</a></nav><main><h1>M {n}</h1><p>Text {n}</p></main>", "M {n} Text {n}"),
    "content": ("<div class='content'><p>Old {n}</p><p>More {n}</p></div><div><p>Aside {n}</p></div>", "Old {n} More {n}"),
    "rest": ("<ul><li><a href='/{n}'>Link {n}</a></li></ul><div><div><p>A long paragraph that has nearly all of the text of page {n}</p></div><p>Tail {n}</p></div><table><tr><td>Cell {n}</td></tr></table>", "A long paragraph that has nearly all of the text of page {n} Tail {n} Cell {n}"),
}


def test_html_zones_are_chosen_per_page(spark):
    from heddle.llm.html_extract import extract

    urls = {"mixed": "https://mixed.example.com/{n}", "null": None, "path": "/{n}"}
    rows, want = [], {}
    for host, url in urls.items():
        for k, (page, text) in enumerate(LAYOUTS.values()):
            for n in range(1 if k == 0 else 4):  # one article page is enough to meet the others
                want[len(rows)] = text.format(n=n)
                rows.append((len(rows), url and url.format(n=n), page.format(n=n)))
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_html_fixed_text_does_not_depend_on_the_number_of_pages(spark):
    from heddle.llm.html_extract import extract

    named = "<{z}><h1>One head</h1><blockquote>One lead</blockquote><h2>Summary</h2><p>Version {n}</p></{z}>"
    plain = "<section><p>All rights reserved</p></section><div><h1>One head</h1><p>Version {n}</p></div>"
    twice = ["<section><p>Same</p><p>Same</p></section><div>Version 0</div>", "<div>Version 1</div>"]
    rows, want = [], {}

    def add(host, html, text):
        want[len(rows)] = text
        rows.append((len(rows), f"https://{host}.example.com/", html))

    for size in (1, 2, 4, 5, 9):
        for empty in (False, True):
            for n in range(size):
                for z in ("article", "main"):
                    add(f"{z}{size}{empty}", named.format(z=z, n=n), f"One head One lead Summary Version {n}")
                add(f"plain{size}{empty}", plain.format(n=n), ("All rights reserved " if size == 1 else "") + f"One head Version {n}")
            for host in (f"article{size}{empty}", f"main{size}{empty}", f"plain{size}{empty}") if empty else ():
                add(host, None, "")
    add("twice", twice[0], "Same Same Version 0")
    add("twice", twice[1], "Version 1")
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


KEPT = ["<h2 id='related-work'>Text {n}</h2>", "<h2 id='form-handling'>Text {n}</h2>", "<section id='social-impact'><p>Text {n}</p></section>", "<section id='menu-design'>Text {n}</section>", "<p class='section-header'>Text {n}</p>", "<h3 id='toc-tree'>Text {n}</h3>", "<div id='data-sharing'>Text {n}</div>", "<h2><span id='ad-hoc'>Text</span> {n}</h2>", "<div class='my-footer-text'>Text {n}</div>", "<h2 class='header'>Text {n}</h2>", "<p class='byline'>Text {n}</p>"]
GONE = ["<div id='comments'><p>Text {n}</p></div>", "<div class='site-footer'>Text {n}</div>", "<div class='ad'>Text {n}</div>", "<p class='advert'>Text {n}</p>", "<div class='cookie-notice'>Text {n}</div>", "<ul class='nav main'><li>Text {n}</li></ul>", "<div id='sidebar-left'>Text {n}</div>", "<aside>Text {n}</aside>", "<form>Text {n}</form>"]


def test_html_parts_of_an_article_by_name(spark):
    from heddle.llm.html_extract import extract

    rows, want = [], {}
    for part, kept in [*((p, True) for p in KEPT), *((p, False) for p in GONE)]:
        for z in ("article", "main"):
            for n in range(2):
                want[len(rows)] = f"Start {n} " + (f"Text {n} " if kept else "") + f"End {n}"
                rows.append((len(rows), f"https://{z}{len(rows) // 2}.example.com/", f"<{z}><p>Start {n}</p>{part.format(n=n)}<p>End {n}</p></{z}>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (t, rows[k][2]) for k, t in got.items()} == {k: (t, rows[k][2]) for k, t in want.items()}


def extracted(spark, rows):
    from heddle.llm.html_extract import extract

    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


NEUTRAL = """<div class="a1"><ul><li><a href="/">Home</a> page</li><li>About us</li></ul></div><div class="b2">{odd}<h2>Part</h2><p>First of {n}</p><p>Second of {n}</p></div><div class="c3"><p>We use small files to remember you.</p></div><div class="d4"><div>Made by somebody</div><div>in some place</div></div>"""


def test_html_host_wrapper_finds_what_one_page_cannot(spark):
    """Neutral names: what all pages of a host share is part of its form; a single page keeps everything."""
    from heddle.llm.html_extract import Wrapper, page_form

    rows, want = [], {}
    for n in range(6):
        want[n] = ("An extra line " if n % 2 else "") + f"Part First of {n} Second of {n}"
        rows.append((n, "https://neutral.example.com/", NEUTRAL.format(n=n, odd="<p>An extra line</p>" if n % 2 else "")))
    want[10], want[11] = "Another layout", "Home page About us Part First of 1 Second of 1 We use small files to remember you. Made by somebody in some place"
    rows += [(10, "https://neutral.example.com/", "<table><tr><td>Another layout</td></tr></table>"), (11, "https://single.example.com/", NEUTRAL.format(n=1, odd="")), (12, "https://neutral.example.com/", None)]
    # the extra line is one of a run of paragraphs, and these differ
    assert extracted(spark, rows) == want | {12: ""}
    alone = {i: Wrapper(page_form(html)).text(html) for i, _, html in rows[:6]}
    assert all(alone[i] != want[i] and alone[i].startswith("Home page About us") for i in range(6))


def test_html_odd_markup(spark):
    deep = 50_000
    rows = [
        ("<p class=it's>Text</p>", "Text"), ("<p title='a>b' class=\"x\">One</p><p data-id=footer>Two", "One Two"), ("<div>" * deep + "Deep", "Deep"), ("<article>" + "<div>" * deep + "<p>Deep</p><nav>Menu</nav>" + "</div>" * deep + "End</article>Out", "Deep End"),
        ("<b>" * deep + "x" + "</i>" * deep, "x"), ("<li>" * 2000 + "x", "x"), ("<p a=\"" * 3000 + "x", ""), ("<p>See <a>a link that is most of the paragraph text</a></p><p>Other</p>", "See a link that is most of the paragraph text Other"),
        ("<div><p>" + "ninety words here " * 90 + "</p></div><div><p>fifteen</p></div>", ("ninety words here " * 90).strip() + " fifteen"), ("<ul><li><a>Home</a></li><li><a>Shop</a></li></ul><div><a>One</a> | <a>Two</a></div><p><a>Linked</a></p>", "Linked"),
        ("a<script>var x='<p>';</script>b <style>p{}</style>c<!-- <p>no</p> -->d", "ab cd"), ("<article>x<video>film</video> <button>Send</button>y &lt;b&gt; &amp;amp; &nbsp; z</article>", "x film y <b> &amp; z"), ("<p>a<", "a<"), ("<", "<"), ("</p></div></x>t", "t"), ("<p>one<p>two<table><tr><td>3<td>4<tr><td>5</table>six", "one two 3 4 5 six"),
        ("<article><header><h1>T</h1>by me</header><p>x</p><article class='comment'><p>nice</p></article></article>", "T x"), ("&#x41;&eacute;&notit;", "Aé¬it;"),
    ]
    got = extracted(spark, [(k, f"https://odd{k}.example.com/", html) for k, (html, _) in enumerate(rows)])
    assert got == {k: text for k, (_, text) in enumerate(rows)}


def test_html_wrappers_are_bounded():
    """Ids made of headings, ever new classes and long alternating levels don't make a wrapper grow with its host."""
    import json

    from heddle.llm.html_extract import PARTS, Wrapper, bounded, merge, page_form

    def slug(n):
        return f"<div class='b2 c{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}'>" + "".join(f"<h2 id='{chr(97 + n % 26)}{'xyz'[k % 3] * (k + n // 26)}'>H {n}</h2><section id='s{'ab'[k % 2] * n}'><p>T {n} {k}</p></section>" for k in range(12)) + "</div><div class='c3'>Same for all</div>"

    sizes, wrapper = [], None
    for n in range(600):
        own = page_form(slug(n))
        wrapper = own if wrapper is None else bounded(merge(wrapper, own))
        sizes.append(len(json.dumps(wrapper)))
    assert sizes[-1] < 2 * max(sizes[:100]) and sizes[-1] < 100 * PARTS
    assert Wrapper(wrapper).text(slug(7)) == " ".join(f"H 7 T 7 {k}" for k in range(12))
    wide = "".join(f"<{t} class=c{chr(97 + k % 26)}{chr(97 + k // 26)}>x{k}</{t}>" for k in range(500) for t in ("div", "h3"))
    assert len(json.dumps(page_form(wide))) < 10_000 and len(Wrapper(page_form(wide)).text(wide).split()) == 1000


def test_html_against_a_generator(spark):
    """Random pages of random layouts, put together from parts whose main text is known."""
    rng, rows, want = np.random.default_rng(5), [], {}
    word = lambda: f"w{rng.integers(0, 10**6)}"
    words_ = lambda n: " ".join(word() for _ in range(n))

    def block():
        a, b, c = words_(3), words_(2), words_(4)
        return [(f"<p>{a} <em>{b}</em>,\n {c}</p>", f"{a} {b}, {c}"), (f"<p>{a}", a), (f"<h2 id='{b.replace(' ', '-')}'>{a}</h2>", a), (f"<ul><li>{a}<li>{b}</ul>", f"{a} {b}"), (f"<div class='box'>{a}<br>{b}</div>", f"{a} {b}"), (f"<blockquote>{a} &amp; {b}</blockquote>", f"{a} & {b}"), (f"<table><tr><td>{a}</td><td>{b}</td></tr></table>", f"{a} {b}"), (f"<pre>{a}\n\t{b}</pre>", f"{a} {b}"), (f"<div><div>{a}</div>{b}</div>", f"{a} {b}")][rng.integers(9)]

    out_parts = ["<nav><ul><li><a href='/'>{a}</a></li></ul></nav>", "<header>{a}</header>", "<footer><p>{a}</p></footer>", "<aside>{a}</aside>", "<div class='cookie-notice'><p>{a}</p></div>", "<div id='sidebar'>{a}</div>", "<form><label>{a}</label><input></form>", "<script>{a}</script>", "<section class='comments'><article>{a}</article></section>", "<!-- {a} -->", "<div class='ad'>{a}</div>"]
    for page in range(300):
        body, text, kind = [], [], page % 3
        for _ in range(rng.integers(1, 9)):
            html, t = block()
            body.append(html)
            text.append(t)
            if rng.random() < 0.3 and kind < 2:
                body.append(out_parts[rng.integers(len(out_parts))].format(a=words_(3)))
        around = [out_parts[rng.integers(len(out_parts))].format(a=words_(3)) for _ in range(4)]
        inner = {0: "<article>{x}</article>", 1: "<main>{x}</main>", 2: "<div class='q7'>Same words on each page</div><section class='q8'>{x}</section><div class='q9'><i>and here</i></div>"}[kind].format(x="".join(body))
        rows.append((page, f"https://h{kind}.example.com/{page}", f"<html><head><title>{words_(2)}</title></head><body>{around[0]}{around[1] if kind < 2 else ''}{inner}{around[2] if kind < 2 else ''}{around[3]}</body></html>"))
        want[page] = " ".join(text)
    got = extracted(spark, rows)
    assert {k: (rows[k][2], got[k], want[k]) for k in want if got[k] != want[k]} == {}


def check_shrinkage(rows, weight=0.5):
    """Site rates and scores by loops, from the documents' own probabilities."""
    good = [r.quality_probability * (1 - r.toxic_probability) for r in rows]
    sums = lambda keys: {k: (sum(1 for x in keys if x == k), sum(g for x, g in zip(keys, good, strict=True) if x == k)) for k in set(keys)}
    by_path, by_host = sums([(r.host, r.path) for r in rows]), sums([r.host for r in rows])
    n, total = len(rows), sum(good)
    rate = min(1 - 1e-6, max(1e-6, total / n))

    def strength(groups):
        parents = len({p for _, _, p in groups})
        ss = sum(k * (s / k - p[1] / p[0]) ** 2 for k, s, p in groups)
        free = sum(k - k * k / p[0] for k, _, p in groups)
        between = (ss - rate * (1 - rate) * (len(groups) - parents)) / free if free > 1e-9 else None
        return 100.0 if between is None else min(1e6, max(1.0, rate * (1 - rate) / between - 1)) if between > 1e-9 else 1e6

    a_path = strength([(*v, by_host[k[0]]) for k, v in by_path.items()])
    a_host = strength([(*v, (n, total)) for v in by_host.values()])
    odds = lambda p: np.log(p / (1 - p))
    cut_ = lambda p: min(1 - 1e-6, max(1e-6, p))
    for r, g in zip(rows, good, strict=True):
        (k, s), (hk, hs) = by_path[r.host, r.path], by_host[r.host]
        host = (hs - g + a_host * rate) / (hk - 1 + a_host)
        site = (s - g + a_path * host) / (k - 1 + a_path)
        final = 1 / (1 + np.exp(-(odds(cut_(g)) + weight * (odds(cut_(site)) - odds(rate)))))
        assert abs(r.site_rate - site) < 1e-6 and abs(r.score - final) < 1e-6 and r.keep == (r.score >= 0.5)


def test_quality(spark, nothing):
    from heddle.llm.quality import kept, score

    good = [(i, " ".join(f"word{(i * 31 + k * 7) % 211} and" for k in range(60)) + ".", "good/x", 1, 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"WORD{(i * 17 + k) % 97}!!" for k in range(60)), "bad/y", 0, 0) for i in range(30)]
    toxic = [(200 + i, good[i][1] + " you awful lout", "good/z", 1, 1) for i in range(20)]
    rows = [*good, *junk, *toxic]
    docs = spark.createDataFrame([(r[0], r[1], r[2], "h", 0.5) for r in rows] + [(None, None, None, "h", 0.0), (999, "", "bad/y", "h", 0.0), (0, good[0][1], "good/x", "h", 0.0)], "doc_id long, text string, source string, host string, score double")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows[::2]] + [(None, 1, 0), (5000, None, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, labels)
    keep = {r.doc_id: r.keep for r in got.collect()}
    assert got.count() == len(rows) + 3 and all(keep[r[0]] for r in good) and not any(keep[r[0]] for r in [*junk, *toxic])
    rates = {r.host: r.site_rate for r in got.collect()}
    assert rates["good"] > rates["bad"]
    again = {r.doc_id: r.keep for r in score(docs, labels.unionByName(labels)).collect()}
    assert again == keep
    check_shrinkage(got.collect())
    left = kept(docs, got)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {r[0] for r in good}
    assert all(r.keep for r in score(docs, labels.where("false")).collect())
    assert score(nothing, labels).count() == 0


def test_pipeline(spark):
    """Every stage against a plain version on its own input."""
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    from heddle.llm.decontaminate import tiles
    from heddle.llm.decontaminate import words as runs
    from heddle.llm.quality import score

    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    docs = [all_docs(spark)]
    for k, (_, stage) in enumerate(P.STAGES):
        docs.append(stage(spark, docs[k], SMALL).persist())
        if k < 4:
            assert docs[k + 1].columns == docs[k].columns
    keep = {r.doc_id for r in score(docs[0], all_docs(spark, "labels")).collect() if r.keep}
    assert rows(docs[1]) == [r for r in rows(docs[0]) if r[0] in keep] and len(keep) > 100
    top = {i: c for i, _, c in brute_join(rows(docs[1]), 5, 80, 100)}
    assert rows(docs[2]) == [r for r in rows(docs[1]) if top[r[0]] == r[0]]
    sha = {i: (gone, digest) for i, _, gone, digest in brute_dedup(rows(docs[2]))}
    for (i, was), (j, now) in zip(rows(docs[2]), rows(docs[3]), strict=True):
        assert i == j and (now == was if not sha[i][0] else hashlib.sha256(now.encode()).hexdigest() == sha[i][1])
    code: dict[str, int] = {}
    numbers = lambda text: [code.setdefault(w, len(code)) for w in runs(text)]
    items = [numbers(r.text) for r in all_docs(spark, "benchmark").collect() if r.text]
    seeds = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in items]

    def leaks(text):
        own = numbers(text)
        grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        return any(len(t) >= 5 and g & grams and sum(n for _, _, n in tiles(t, own, 5)) >= 0.5 * len(t) for t, g in zip(items, seeds, strict=True))

    assert rows(docs[4]) == [r for r in rows(docs[3]) if not leaks(r[1])]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows(docs[4])}
    assert {r.doc_id: r.n for r in docs[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset)
    assert sorted(map(key, P.run(spark, SMALL).collect())) == sorted(map(key, docs[5].collect()))


def test_pipeline_of_odd_tables(spark, docs, nothing):
    """Nulls, repeats and clashing columns go through all stages; an empty table stays empty."""
    import corpus_pipeline as P

    for start in (docs, nothing):
        df = start
        for k, (_, stage) in enumerate(P.STAGES):
            before, df = df, stage(spark, df, SMALL)
            if k < 4:
                assert df.columns == before.columns
                assert df.count() <= before.count()
        assert (df.count() == 0) == (start is nothing)
