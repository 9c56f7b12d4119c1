"""Properties of the inner data structures on generated inputs."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm.common import Rolling, hash_texts, shingle_sets, shingles, sliding

WORDS = st.lists(st.sampled_from("abc"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5), WORDS)
def test_suffix_automaton(texts, query):
    """Longest matches and the smallest owner of every window agree with a search."""
    from heddle.llm.substring_dedup import SuffixAutomaton

    automaton = SuffixAutomaton()
    for owner, words in enumerate(texts):
        automaton.add(words, len(texts) - owner)
    automaton.settle()
    whole = ["".join(t) for t in texts]
    q = "".join(query)
    for end, (have, state) in enumerate(automaton.statistics(query), 1):
        want = max(n for n in range(end + 1) if any(q[end - n : end] in t for t in whole))
        assert have == want
        for size in range(1, have + 1):
            owners = [len(texts) - k for k, t in enumerate(whole) if q[end - size : end] in t]
            assert automaton.first_owner(state, size) == min(owners)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=40), st.integers(2, 5))
def test_tiles(item, doc, least):
    """Tiles are equal stretches, don't overlap, and leave no free match of the least length."""
    from heddle.llm.decontaminate import tiles

    found = tiles(item, doc, least)
    used_i, used_d = [0] * len(item), [0] * len(doc)
    for i, d, n in found:
        assert n >= least and item[i : i + n] == doc[d : d + n]
        for k in range(n):
            used_i[i + k] += 1
            used_d[d + k] += 1
    assert max([0, *used_i, *used_d]) <= 1
    free = lambda used, at: not any(used[at : at + least])
    assert not any(item[i : i + least] == doc[d : d + least] for i in range(len(item) - least + 1) if free(used_i, i) for d in range(len(doc) - least + 1) if free(used_d, d))


def brute_tiles(item, doc, least):
    """Greedy string tiling as it is defined: again and again the longest free match, the first of several."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                best = min(best, (-n, i, d))
        n, i, d = -best[0], best[1], best[2]
        if n < least:
            return out
        free_i[i : i + n] = free_d[d : d + n] = [False] * n
        out.append((i, d, n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=24), st.lists(st.integers(0, 2), max_size=30), st.integers(1, 4))
def test_tiles_are_those_of_greedy_string_tiling(item, doc, least):
    from heddle.llm.decontaminate import tiles

    assert tiles(item, doc, least) == brute_tiles(item, doc, least)


def test_tiles_of_repetitive_texts():
    from heddle.llm.decontaminate import tiles

    assert tiles([1] * 60, [1] * 50_000, 5) == [(0, 0, 60)]
    assert sum(n for _, _, n in tiles([1, 2] * 40, [2, 1] * 20_000, 5)) == 80


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1c\x85\xa0", max_size=30)), max_size=8), st.integers(1, 20))
def test_hash_texts(texts, piece):
    """Words as bytes.split() has them, whatever the pieces; equal words have equal hashes and others differ."""
    raw = [t.encode() if t is not None else None for t in texts]
    hashes, offsets = hash_texts(raw, piece=piece)
    words = [(t or b"").split() for t in raw]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist())) and len({(w, int(h)) for w, h in zip(flat, hashes, strict=True)}) == len(set(flat))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=30), st.integers(1, 6))
def test_shingles(values, n):
    h = np.array(values, np.uint64)
    got = shingles(h, n)
    want = {tuple(values[k : k + n]) for k in range(len(values) - n + 1)} or ({tuple(values)} if values else set())
    assert len(got) == len(want)
    assert np.array_equal(shingle_sets([b"a b c a b c", None, b"x"], 3)[0], shingle_sets([b"A b C a b c"], 3)[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding(values, width):
    x = np.array(values)
    assert sliding(x, width, np.minimum).tolist() == [min(values[k : k + width]) for k in range(len(values) - width + 1)] if width <= len(values) else True


def test_ranges_depend_on_place_only_by_content():
    h = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    r = Rolling(h)
    a = r.ranges(np.array([0, 3, 0]), np.array([3, 6, 2]))
    assert a[0] == a[1] != a[2]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.sampled_from([1, 64, 1024]))
def test_binary_lengths(total, capacity):
    from heddle.llm.packing import binary_lengths

    got = binary_lengths(total, capacity)
    assert sum(got) == total and all(n & (n - 1) == 0 and n <= capacity for n in got) and got == sorted(got, reverse=True)


@pytest.mark.parametrize("raw", [b"a", b"ab", b"aaaa", b"abababab", b"hello world" * 30, bytes(range(256))])
def test_merges_are_symbols_less_merges(raw):
    P = pytest.importorskip("public_tokenizers")
    from heddle.llm.token_counts import merger

    tool = merger(P.path("byte_bpe_50k.json"))
    parts = [raw[i : i + 1] for i in range(len(raw))]
    merges = 0
    while True:  # the plain way: the lowest rank, leftmost, again and again
        best = min(((tool.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        merges += 1
    assert tool.piece(raw) == len(raw) - merges


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=4), max_size=12))
def test_cover(texts):
    from heddle.llm.quality import cover

    texts = [sorted(set(t)) for t in texts]
    chosen = cover(texts, 1)
    assert all(not t or set(t) & set(chosen) for t in texts) and len(chosen) == len(set(chosen))


def thue_morse(n, a, b):
    """The word sequence that collides in any polynomial hash modulo a power of two, and its complement."""
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out[:n]


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_structured_words_do_not_collide(n):
    one, two = "".join(thue_morse(n, "a", "b")).encode(), "".join(thue_morse(n, "b", "a")).encode()
    hashes, _ = hash_texts([one, two])
    assert hashes[0] != hashes[1]
    left, right = (Rolling(hash_texts([" ".join(thue_morse(n, *ab)).encode()])[0]) for ab in ("xy", "yx"))
    assert left.ranges(np.array([0]), np.array([n]))[0] != right.ranges(np.array([0]), np.array([n]))[0]
    again = Rolling(hash_texts([b"other words " + " ".join(thue_morse(n, "x", "y")).encode()])[0])
    assert again.ranges(np.array([2]), np.array([n + 2]))[0] == left.ranges(np.array([0]), np.array([n]))[0]
