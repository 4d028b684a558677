import random

import numpy as np
from corvane.llm import neardup
from corvane.llm.neardup import groups_of, pairs_of, similar_sets, trie_join
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def made(n=300, seed=1):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    sets = {}
    for i in range(n):
        if i and rng.random() < 0.5:
            base = set(sets[rng.randrange(i)])
            for _ in range(rng.randrange(3)):
                base ^= {rng.choice(common + rare)}
        else:
            base = set(rng.sample(common, rng.randrange(1, 9))) | set(rng.sample(rare, rng.randrange(6)))
        sets[i] = base
    return sets


def test_all_pairs(spark):
    sets = made()
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, words array<string>")
    for t in (0.5, 0.7, 0.9):
        for hot in (5, 20_000):
            links, members = similar_sets(df, "id", "words", t, hot=hot)
            assert {(r.a, r.b) for r in pairs_of(links, members).collect()} == brute(sets, t), (t, hot)


def test_edges(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (2, ["b", "a"]), (3, []), (4, None), (None, ["a", "b"]), (5, ["x"])], "id bigint, words array<string>")
    links, members = similar_sets(df, "id", "words", 0.7)
    assert links.count() == 0
    assert {(r.id, r.class_id) for r in members.collect()} == {(1, 1), (2, 1), (5, 5)}
    assert [(r.a, r.b) for r in pairs_of(links, members).collect()] == [(1, 2)]
    none, nobody = similar_sets(df.limit(0), "id", "words", 0.7)
    assert none.count() == 0 and nobody.count() == 0 and pairs_of(none, nobody).count() == 0


def test_groups(spark):
    sets = made(120, 3)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, words array<string>")
    links, members = similar_sets(df, "id", "words", 0.7)
    root = {i: i for i in sets if sets[i]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(sets, 0.7):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.id: r.group_id for r in groups_of(links, members).collect()} == {i: find(i) for i in root}


def test_no_join_is_broadcast(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    real = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df: plan(df) or real(df))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    df = spark.range(60).selectExpr("id", "transform(sequence(0, 9), i -> concat('w', if(i < 8, id div 6, id div 3), '_', i)) words")
    links, members = similar_sets(df, "id", "words", 0.6, hot=5)
    for out, rows in ((links, 10), (pairs_of(links, members), 150), (groups_of(links, members), 60)):
        plan(out)
        assert out.count() == rows
    assert len(plans) >= 6 and sum(p.count("SortMergeJoin") for p in plans) >= 10
    assert not any("Broadcast" in p for p in plans)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)], "a bigint, b bigint")
    members = spark.createDataFrame([(i, i) for i in range(71)] + [(500, 3), (600, 600)], "id bigint, class_id bigint")
    got = {r.id: (r.group_id, r.n_links) for r in groups_of(links, members).collect()}
    assert {g for i, (g, _) in got.items() if i != 600} == {0} and got[600] == (600, 0) and got[500] == (0, 2) and got[0] == (0, 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2**12 - 1), st.integers(1, 20)), max_size=120))
def test_trie_holds_every_pair_in_budget(rows):
    key = np.array([r[0] for r in rows], np.int64)
    sketch = np.array([r[1] for r in rows], np.uint64)
    size = np.array([r[2] for r in rows], np.int64)
    got = [tuple(sorted(p)) for a, b in trie_join(key, sketch, size, 0.7) for p in zip(a.tolist(), b.tolist())] if rows else []
    share = 0.3 / 1.7
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if key[i] == key[j] and int(sketch[i] ^ sketch[j]).bit_count() <= share * (size[i] + size[j]) + 1e-9 and min(size[i], size[j]) >= 0.7 * max(size[i], size[j]) - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_pairs_of_words_are_split(spark, monkeypatch):
    rng = random.Random(6)
    sets = {i: {"hot", "pair"} | set(rng.sample([f"m{j}" for j in range(9)], 3)) | {f"r{rng.randrange(400)}" for _ in range(rng.randrange(3))} for i in range(400)}
    sets |= {1000 + i: {"hot", "pair"} | ({f"x{i}"} if i else set()) for i in range(12)} | {2000 + i: {f"w{(i * 7 + j) % 50}" for j in range(8)} for i in range(50)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, words array<string>")
    depths = []
    real = neardup._hot_chains
    monkeypatch.setattr(neardup, "_hot_chains", lambda *a: depths.append(real(*a)) or depths[-1])
    for t in (0.5, 0.7, 0.8):
        links, members = similar_sets(df, "id", "words", t, hot=20)
        assert {(r.a, r.b) for r in pairs_of(links, members).collect()} == brute(sets, t), t
    assert max(map(len, depths)) >= 2


def test_tries_are_bounded():
    rng = np.random.default_rng(2)
    rows = [np.unique(np.concatenate([rng.integers(0, 6, 4), 1000 + rng.integers(0, 30, 8)])).astype(np.int64) for _ in range(3000)]
    hashes, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    keys, counts = np.unique(hashes, return_counts=True)
    hot, deeper = 60, []
    while True:
        every = list(neardup.chains(hashes, starts, 0.8, keys, counts, hot, deeper, len(deeper) + 2))
        if len(every) < len(deeper) + 2:
            break
        k, n = np.unique(every[-1][1], return_counts=True)
        if not (n >= hot).any():
            break
        deeper.append(k[n >= hot])
    _, key = neardup.route(hashes, starts, 0.8, keys, counts, hot, deeper)
    assert np.unique(key, return_counts=True)[1].max() < hot and deeper
