"""Hard negatives, token alignment and language identification against brute force, with odd, repeated and empty rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import alignment, langid, negatives
from tests.conftest import SMALL

pytest.importorskip("public_tokenizers")
KIND = "vec_id long, embedding array<float>, label int, pivot string, score double, id long"


def brute_negatives(rows, positives=5, count=3, every=50):
    """rows of (id, vector, label)."""
    use = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in use:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (label, vector) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(vector, v, strict=False)), i, y) for i, v, y in use if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(i, -t) for t, i, y in scored if y != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fits[:count])]
    return Counter(out)


def mined(df, **more):
    found = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"), **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


def vectors(n, seed, centers=0, labels=4, width=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + (rng.normal(size=(centers, width)) * 6)[rng.integers(0, centers, n)] if centers else rng.normal(size=(n, width))
    return [(int(i), [float(np.float32(v)) for v in row], int(rng.integers(0, labels))) for i, row in enumerate(x)]


@pytest.mark.parametrize(("centers", "shard_rows", "pivots"), [(0, 64, 16), (5, 50, 40), (5, 8192, 512)])
def test_negatives_equal_brute_force(spark, centers, shard_rows, pivots):
    rows = vectors(700, 3 + centers, centers)
    df = spark.createDataFrame([(*r, "p", 0.5, 1) for r in rows], KIND)
    assert mined(df, shard_rows=shard_rows, max_pivots=pivots) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = [
        *vectors(120, 9),
        (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1), (204, [0.5] * 8, None), (None, [0.5] * 8, 1),
        (250, [0.5] * 8, 1), (251, [0.5] * 8, 1), (252, [0.5] * 8, 2), (252, [0.5] * 8, 2), (253, [0.4] * 8, 2), (254, [0.0] * 8, 2),
        (300, [0.0] * 8, 3), (301, [0.0] * 8, 3), (350, [1.0] * 8, 77),
    ]
    rows += [(400 + k, [0.25] * 8, 1 + k % 2) for k in range(150)]  # many copies under two labels
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], KIND)
    assert mined(df, shard_rows=40, max_pivots=8) == brute_negatives(rows)
    assert mined(df.where("vec_id is null")) == Counter()
    assert mined(df.where("vec_id = 350")) == Counter()


def test_negatives_refuse_scores_that_do_not_fit(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0], 1, None, None, None), (1, [3e30, 2.0], 1, None, None, None)], KIND)
    with pytest.raises(ValueError, match="may not fit"):
        mined(df)


def test_annuli_end_early_on_clustered_vectors():
    rows = vectors(3000, 5, centers=30)
    v = negatives._stack([[math.floor(256 * x) for x in r[1]] for r in rows], 8)
    most = float((v.astype(float) ** 2).sum(1).max())
    keys = negatives.Keys(v[:64], most)
    pivot, distance = keys.of(v.astype(float))
    order = np.lexsort((distance, pivot))
    pages = []
    for p in np.unique(pivot):
        mine = order[pivot[order] == p]
        for at in range(0, len(mine), 32):
            some = mine[at : at + 32]
            pages.append((int(p), distance[some[0]], distance[some[-1]], some.astype(np.int64), np.array([rows[i][2] for i in some], np.int64), v[some]))
    asked = range(0, 3000, 50)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    probes = negatives.Probes(list(asked), [rows[i][2] for i in asked], v[::50], [[low]] * 60, [[high]] * 60, [[low]] * 60, most)
    found, computed = negatives.scan(pages, probes, keys, True, 5)
    assert computed < 0.5 * 60 * 3000
    for j, a in enumerate(asked):
        want = sorted((-int(v[a] @ v[i]), i) for i in range(3000) if i != a and rows[i][2] == rows[a][2])[:5]
        assert [(i, s) for k, i, s in found if k == j] == [(i, -s) for s, i in want]


# ---- alignment

TEXTS = [
    (1, "The quick brown fox, 12 345 jumps."), (2, "Ünïcödé — ①②  naïve\n\n\tcafé 日本語 🙂"), (3, None), (4, ""), (5, " "), (6, "raw ▁ sign"), (7, "<s> </s> <|endoftext|> <unk> <0x41>"),
    (8, "a" * 3000), (9, " " * 3000 + "x"), (10, "The quick brown fox, 12 345 jumps."), (None, "null id"), (11, "line\r\nend\x00\x7f"), (12, "the the the cat " * 400),
]


def tools():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute_alignment(texts):
    from heddle.llm.token_counts import byte_symbols

    a, b = tools()
    back = {c: v for v, c in byte_symbols().items()}
    per, pairs = [], Counter()
    for i, text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a]
        raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            per.append((i, [], [], "", []))
            continue
        spans = [[(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))] for raw in (raw_a, raw_b)]
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in both:
            inside = [",".join(str(x) for x, (s, e) in zip(ids, some, strict=True) if start <= s and e <= end) for ids, some in zip((ids_a, ids_b), spans, strict=True)]
            groups.append("|".join(inside))
            start = end
        linked = [(x, y) for x, (s, e) in zip(ids_a, spans[0], strict=True) for y, (t, f) in zip(ids_b, spans[1], strict=True) if s < f and t < e]
        pairs.update(set(linked))
        per.append((i, ids_a, ids_b, groups, linked))
    most = {}
    for (x, _), n in pairs.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for i, ids_a, ids_b, groups, linked in per:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(ids_a), len(ids_b), len(groups), len(linked), sum(pairs[x] == most[x[0]] for x in linked), sum(pairs[x] for x in linked), digest))
    return Counter(out)


def files():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("max_pairs", [2_000_000, 0])
def test_alignment_equals_brute_force(spark, max_pairs):
    # with no room for a broadcast the counts are joined
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in TEXTS], "doc_id long, text string, row string, n long, pairs int")
    found = alignment.align(df, *files(), max_pairs=max_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == brute_alignment(TEXTS)
    assert alignment.align(df.limit(0), *files(), max_pairs=max_pairs).count() == 0


def test_alignment_query_equals_brute_force(spark):
    from heddle.llm.queries import op12_alignment

    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    short = {i for i, t in texts if t is not None and len(t) < 1500}
    want = {r[0]: r for r in brute_alignment([x for x in texts if x[0] in short])}
    found = {r["doc_id"]: tuple(r) for r in op12_alignment(spark, SMALL).collect()}
    assert len(found) == len(texts)
    # the corpus-wide counts need all texts; the rest is each text's own
    assert all(found[i][:5] == want[i][:5] and found[i][7] == want[i][7] for i in short)


def test_alignment_counts_over_the_corpus(spark):
    from heddle.llm.queries import op12_alignment

    tool = alignment.aligner(*files())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    per = {i: tool.align(t)[5:] for i, t in rows}
    counts = Counter(p for pairs, _ in per.values() for p in pairs.tolist())
    size = len(tool.b.tokens)
    most = {}
    for p, n in counts.items():
        most[p // size] = max(n, most.get(p // size, 0))
    for r in op12_alignment(spark, SMALL).collect():
        pairs, times = per[r["doc_id"]]
        assert r["count_sum"] == sum(counts[p] * t for p, t in zip(pairs.tolist(), times.tolist(), strict=True))
        assert r["n_best"] == sum(t for p, t in zip(pairs.tolist(), times.tolist(), strict=True) if counts[p] == most[p // size])


def test_long_texts_align(spark):
    tool = alignment.aligner(*files())
    for text in (" " * 1_000_000, "word " * 100_000, "\n" * 300_000):
        n_a, n_b, n_groups, n_links, digest, _, _ = tool.align(text)
        assert n_a and n_b and 0 < n_groups <= min(n_a, n_b) and n_links == n_a + n_b - n_groups and digest


# ---- languages


def test_language_counts_do_not_depend_on_pieces():
    grams = langid.Grams(buckets=1 << 10)
    for text in ("Hello, wörld! 123 ABC", "  a  b  ", "x", "1a", "a1", "Ünï—cödé " * 50, "ab" * 40 + "..." * 40 + "c"):
        whole = grams.counts(text)
        for piece in (1, 2, 3, 7, 64):
            assert (grams.counts(text, piece) == whole).all(), (text, piece)
        line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        # the blank before the text is part of n-grams, none of its own
        assert whole.sum() == sum(max(0, len(line) - n + 1) for n in range(1, 5)) - 1
    for text in (None, "", "123 .,;", "②½"):
        assert grams.counts(text) is None


def test_language_of_held_out_documents(spark):
    from heddle.llm.queries import op13_language_id

    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = op13_language_id(spark, SMALL).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_prediction_is_the_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs, "doc_id", "text", "lang", grams=langid.Grams(buckets=1 << 12))
    assert all(2 <= (model.owner == k).sum() <= 4 for k in range(len(model.languages)))
    texts = [r["text"] for r in docs.select("text").collect()]
    seen = [c for c in map(model.grams.counts, texts) if c is not None]
    df = sum(c > 0 for c in seen)
    assert np.allclose(model.idf, np.log((1 + len(seen)) / (1 + df)) + 1)
    for text in texts[:40]:
        c = model.grams.counts(text)
        v = np.array([(1 + math.log(n)) * w if n else 0.0 for n, w in zip(c.tolist(), model.idf.tolist(), strict=True)])
        near = (v / np.linalg.norm(v)) @ model.centers
        assert model.predict(text)[0] == model.languages[model.owner[int(near.argmax())]]
        assert abs(model.predict(text)[3] - (1 - near.max())) < 1e-9


def test_languages_of_odd_rows(spark):
    english, french = "the house of the king and the queen is here ", "la maison de la reine et du roi est ici "
    rows = [(k, (english if k % 2 else french) * (1 + k % 3), "en" if k % 2 else "fr") for k in range(60)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "123 ;", "en"), (103, english, None), (None, french, "fr"), (104, "日本語の文章です", None), (105, french * 5000, None)]
    df = spark.createDataFrame([(*r, 1, "s", 0.0) for r in rows], "doc_id long, text string, lang string, place int, at string, score double")
    found = {r["doc_id"]: r for r in langid.identify(df, langid.held_out(F.col("doc_id"))).collect()}
    assert len(found) == len(rows) and set(found[100]) >= {100, "und", 0.0}
    assert [found[k]["lang_pred"] for k in (100, 101, 102, 103, None, 105)] == ["und", "und", "und", "en", "fr", "fr"]
    assert found[104]["lang_pred"] in ("en", "fr") and found[104]["rejected"] and not found[103]["rejected"]
    nothing = langid.identify(df.where("lang is null"), langid.held_out(F.col("doc_id"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify(df.limit(0), langid.held_out(F.col("doc_id"))).count() == 0


# ---- large components of the top-k search


def test_top_k_is_exact_or_raises(spark):
    from heddle.llm.topk import top_k

    kind = "vec_id long, embedding array<double>, score double, rank string"
    big = spark.createDataFrame([(0, [1e18, 1.0], 0.0, "a"), (1, [3e30, 2.0], 0.0, "a"), (2, [1.0, 1e15], 0.0, "a")], kind)
    with pytest.raises(ValueError, match="may not fit"):
        top_k(big, F.col("vec_id") % 50 == 0).collect()
    # just below: over 2**53, where doubles are no longer exact
    rows = [(k, [float(2**20 + k), float(-(2**21) + 3 * k), float(2**21 - k)]) for k in range(120)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], kind)
    want = []
    for q in range(0, 120, 50):
        s = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(rows[q][1], v, strict=True)), i) for i, v in rows if i != q)[:5]
        want += [(q, k + 1, i, -t) for k, (t, i) in enumerate(s)]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
