import random

import numpy as np
import pytest
from corvane.llm.mixing import PARTS, Frames, mix, plan, schedule, schedules
from corvane.llm.packing import fill_report, harmonic, most_pieces, pack
from corvane.llm.tokens import count_tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_bins_hold(sizes):
    sizes = np.array(sizes, np.int64)
    bins = harmonic(sizes, 100)
    assert len(bins) == len(sizes) and (bins >= 0).all()
    if len(sizes):
        assert np.bincount(bins, weights=sizes).max() <= 100
        assert bins.max() + 1 <= 1.7 * -(-sizes.sum() // 100) + 2


def test_fixed_counts():
    assert sorted(np.bincount(harmonic(np.full(30, 30), 100)).tolist()) == [3] * 10


def test_pack(spark):
    rng = random.Random(5)
    items = [(i, "a", rng.choice([0, 5, 50, 120, 700, 1000, 2500])) for i in range(900)] + [(900, "a", 10**6)]
    df = spark.createDataFrame(items, "key bigint, tokenizer string, tokens bigint")
    specs = spark.createDataFrame([(1, "a", 1000), (2, "a", 300), (3, "b", 10), (4, "a", 0), (5, None, 7)], "spec_id int, tokenizer string, capacity_tokens int")
    packed = pack(df, specs, 901, shard_items=300)
    for spec, cap in ((1, 1000), (2, 300)):
        rows = packed.filter(f"spec_id = {spec}").collect()
        bins, docs = {}, {}
        for r in rows:
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.size
            docs.setdefault(r.key, []).append((r.part, r.start, r.size))
        assert max(bins.values()) <= cap
        for key, _, n in items:
            parts = sorted(docs.get(key, []))
            assert sum(s for _, _, s in parts) == n and (len(parts) <= 1 or n > cap)
            assert [p for p, _, _ in parts] == list(range(len(parts))) and all(a == p * cap for p, a, _ in parts)
    used = {r.spec_id: r.used for r in fill_report(packed, specs).collect()}
    assert set(used) == {1, 2} and used[1] > 0.97
    assert pack(df.limit(0), specs, 0).count() == 0
    assert most_pieces(df, specs) == sum(-(-n // 300) for _, _, n in items) and most_pieces(df.limit(0), specs) == 0
    long = pack(df.filter("key = 900"), specs, 1000, shard_items=100).filter("spec_id = 1")
    assert long.count() == 1000 and long.groupBy((F.col("bin_id") / (1 << 32)).cast("int")).count().count() == 10


def test_schedule_is_fair():
    weights = {"a": 50, "b": 30, "c": 15, "d": 5}
    slots = schedule(weights)
    assert sorted(x for v in slots.values() for x in v) == list(range(100))
    for s, w in weights.items():
        for t in range(101):
            assert abs(sum(x < t for x in slots[s]) - w * t / 100) < 1


@pytest.mark.parametrize("blocks,size", [({"a": 1_400_000, "b": 599_998, "c": 2}, 16_384), ({"a": 50, "b": 30, "c": 15, "d": 5}, 16_384), ({"a": 333, "b": 334, "c": 1, "d": 5000, "e": 77, "f": 2}, 100), ({"a": 7}, 3), ({"a": 1, "b": 10**6}, 1000)])
def test_frames_are_fair(blocks, size):
    frames, total = Frames(blocks, size), sum(blocks.values())
    taken = np.full(total, -1)
    for i, (s, n) in enumerate(blocks.items()):
        slots = frames.slots(s, np.arange(n))
        assert (np.diff(slots) > 0).all()
        taken[slots] = i
        ahead = np.arange(1, n + 1) - (slots + 1) * (n / total)  # right after a block of its own
        behind = np.arange(n + 1) - np.append(slots, total) * (n / total)  # right before one
        assert ahead.max() < PARTS and behind.min() > -PARTS
        if total <= size:
            assert ahead.max() < 1 and behind.min() > -1
    assert (taken >= 0).all()


def test_frames_hold_under_any_shares():
    rng = random.Random(4)
    for _ in range(40):
        blocks = {str(i): int(10 ** rng.uniform(0, 4.5)) for i in range(rng.randrange(1, 10))}
        frames, total = Frames(blocks, rng.choice([10, 64, 1000])), sum(blocks.values())
        for s, n in blocks.items():
            slots = frames.slots(s, np.arange(n))
            off = np.concatenate([np.arange(1, n + 1) - (slots + 1) * (n / total), np.arange(n) - slots * (n / total)])
            assert abs(off).max() < PARTS


def test_schedules_are_the_same_at_once():
    rng = np.random.default_rng(1)
    held = np.concatenate([rng.integers(0, 30, (40, 5)), [[0, 0, 0, 0, 0], [7, 0, 0, 0, 0], [1, 1, 1, 1, 1], [500, 1, 1, 0, 3]]])
    for row, made in zip(held, schedules(held), strict=True):
        want = schedule({str(i): int(w) for i, w in enumerate(row)})
        assert [np.flatnonzero(made == i).tolist() for i in range(5)] == list(want.values()) and (made[row.sum() :] == -1).all()


def test_a_mix_of_very_many_blocks_is_sent_small():
    rng = random.Random(0)
    frames = Frames({f"s{i}": int(rng.uniform(0.01, 1) * 65_536 * 2048 / 9) for i in range(9)})
    frames.made()
    first, start, kind, flat, at = frames._made
    assert len(kind) <= 65_536 and sum(x.nbytes for d in (first, flat, at) for x in d.values()) + start.nbytes + kind.nbytes < 32 << 20


def test_plan():
    p = plan({"a": 100, "b": 100, "c": 0}, {"a": 0.6, "b": 0.2, "c": 0.2}, {"a": 1, "b": 3, "c": 9})
    assert set(p.quota) == {"a", "b"} and abs(p.quota["a"] - 100) < 1e-6 and abs(p.quota["b"] - 100 / 3) < 1e-6
    p = plan({"a": 100, "b": 1000}, {"a": 0.6, "b": 0.4}, {"a": 2, "b": 1}, total=1000)
    assert p.quota == {"a": 200.0, "b": 800.0}
    assert plan({}, {"a": 1.0}, {"a": 1}).quota == {}


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 else "mid", rng.randrange(1, 60)) for i in range(3000)] + [(5000 + i, "tiny", 40) for i in range(10)] + [(9000, None, 5), (None, "big", 5), (9001, "other", 5), (9002, "big", 0)]
    df = spark.createDataFrame(docs, "key bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("none", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mix(spark, df, targets, block=64)
    rows = sorted(((r.slot, r.source, r.place, r.key, r["copy"], r.tokens) for r in mixed.collect()))
    got = {r.source: r for r in shares.collect()}
    assert got["none"].tokens == 0 and got["tiny"].most_copies == 4
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):
        assert abs(got[s].reached_share - share) < 0.02
        seen = have = 0
        for r in rows:
            seen += r[5]
            have += r[5] * (r[1] == s)
            assert abs(have - seen * share) < 64 + 2 * 60
    assert len({(r[3], r[4]) for r in rows}) == len(rows)
    empty, none = mix(spark, df.limit(0), targets)
    assert empty.count() == 0 and none.count() == 4


def test_shares_name_what_is_left_out(spark):
    docs = [(i, "big", 10) for i in range(100)] + [(200 + i, "tiny", 10) for i in range(2)]
    df = spark.createDataFrame(docs, "key bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("tiny", 0.4, 3), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: (r.available, r.unused, r.tokens) for r in mix(spark, df, targets, block=64)[1].collect()}
    assert got["tiny"] == (20, 0, 60) and got["none"] == (0, 0, 0) and got["big"][:2] == (1000, 1000 - got["big"][2]) and got["big"][1] > 900
    got = {r.source: (r.available, r.unused, r.tokens) for r in mix(spark, df, targets, block=64, total=1020.0)[1].collect()}
    assert got["tiny"] == (20, 0, 60) and got["big"] == (1000, 40, 960)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", None), (4, "<|endoftext|>", "z")], "id bigint, text string, key string")
    rows = count_tokens(df, "id", "text", ["gpt2"], keep=["text"]).select(F.col("key"), "tokens")
    got = {r[0]: r[1] for r in rows.collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1
