"""What substring dedup moves between tasks beyond its broadcast sizes."""

from __future__ import annotations

import random
import string

import pytest

from tests.llm.test_llm_operators import brute_dedup


def moved(spark):
    """(rows, bytes) that all stages so far have written to shuffles."""
    context, gateway = spark._jsparkSession.sparkContext(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None)
    each = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in each), sum(s.shuffleWriteBytes() for s in each)


def shuffled_by(spark, texts):
    """Rows and bytes shuffled without any broadcast join; the rows must be right."""
    from heddle.llm.substring_dedup import remove

    df = spark.createDataFrame(texts, "doc_id long, text string")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before, start = spark.conf.get(conf), moved(spark)
    spark.conf.set(conf, "-1")
    try:
        got = remove(df, small=0).collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(map(tuple, got)) == sorted(brute_dedup(texts))
    return [b - a for a, b in zip(start, moved(spark), strict=True)]


def some(rng, n, letters=40):
    return ["".join(rng.choices(string.ascii_letters + string.digits, k=letters)) for _ in range(n)]


def test_segments_of_one_document_move_once(spark):
    """Two of 200 texts share a passage: the segments of the others are shuffled for their names, and not again to meet the shared ones."""
    from heddle.llm.substring_dedup import all_segments

    rng = random.Random(1)
    passage = some(rng, 60, 6)
    texts = [(i, " ".join([*some(rng, 700, 6), *(passage if i in (7, 150) else []), *some(rng, 700, 6)])) for i in range(200)]
    n = sum(len(s.name) for s in all_segments([t.encode() for _, t in texts], 50))
    rows, _ = shuffled_by(spark, texts)
    assert n > 15_000 and rows < 1.2 * n


def test_whole_texts_meet_no_wanted_segments(spark):
    """All texts share a passage in other surroundings: only segments are shuffled to the automata, and later copies' texts to lose words."""
    rng = random.Random(2)
    passage = some(rng, 60)
    texts = [(i, " ".join([*some(rng, 700), *(passage if i % 2 else passage[:55]), *some(rng, 700)])) for i in range(100)]
    _, size = shuffled_by(spark, texts)
    assert size < 1.5 * sum(len(t) for _, t in texts)


@pytest.mark.parametrize("hot", [1000, 3])
def test_segments_beyond_the_slots(spark, monkeypatch, hot):
    """Slots that are all taken let every segment pass; results are the same."""
    from heddle.llm import common, substring_dedup

    narrow = common.slot_bits
    for module in (common, substring_dedup):
        monkeypatch.setattr(module, "slot_bits", lambda hashes, most: narrow(hashes, 6))
    rng = random.Random(3)
    common_words = [some(rng, 9, 3) for _ in range(4)]
    texts = [(i // 2 * 2 - 20, " ".join(w for _ in range(8) for w in [*rng.choice(common_words), *some(rng, rng.randrange(3), 2)])) for i in range(60)]
    df = spark.createDataFrame([*texts, (3, None)], "doc_id long, text string")
    want = sorted(brute_dedup([*texts, (3, "")], 8))
    assert sum(gone for _, _, gone, _ in want) > 1000
    assert sorted(map(tuple, substring_dedup.remove(df, 8, hot=hot, small=0).collect())) == want


@pytest.mark.parametrize("most", [26, 6])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_having(spark, limit, most):
    from heddle.llm.common import having

    df, keys = spark.range(-500, 500), spark.range(-3000, 3000, 7)
    for table in (keys, keys.where("false")):
        want = sorted(r.id for r in df.join(table, "id", "left_semi").collect())
        assert sorted(r.id for r in having(df.union(spark.createDataFrame([(None,)], "id long")), table, "id", limit, most).collect()) == want
