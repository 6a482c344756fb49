import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gabarit.llm.packing import VOCABULARY, fill, packed, places, solve

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=40))
def test_solution_holds_every_item(counts):
    kinds = solve(counts, 100)
    held = {}
    for n, content in kinds:
        assert sum(s * k for s, k in content.items()) <= 100
        assert sum(k for s, k in content.items() if 3 * s > 100) <= 2
        for s, k in content.items():
            held[s] = held.get(s, 0) + n * k
    assert held == counts
    total = sum(s * n for s, n in counts.items())
    assert sum(n for n, _ in kinds) <= max(2 * total / 100 + 1, 1)
    last = {}
    for s, rank, _, _ in places(kinds):
        assert rank >= last.get(s, 0)
        last[s] = rank


def test_perfect_pairs():
    assert sum(n for n, _ in solve({60: 10, 40: 10, 50: 4}, 100)) == 12
    with pytest.raises(ValueError):
        solve({101: 1}, 100)


@needs_vocabulary
def test_documents(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 5, 60, 300])))) for k in range(200)]
    docs += [(900, None), (901, ""), (902, "word " * 30_000), (None, "x"), (5, docs[5][1])]
    packs = spark.createDataFrame([(1, 64), (2, 512), (2, 512), (3, 0), (None, 5)], "pack_id int, capacity_tokens int")
    df = packed(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_tokens", F.lit(1)), packs)
    rows = df.collect()
    cap = {1: 64, 2: 512}
    room, seen = {}, {}
    for r in rows:
        room[r.pack_id, r.container_id] = room.get((r.pack_id, r.container_id), 0) + r.n_tokens
        seen.setdefault((r.pack_id, r.doc_id), []).append((r.piece, r.first_token, r.n_tokens))
    assert all(t <= cap[p] for (p, _), t in room.items())
    assert {d for _, d in seen} == {d[0] for d in docs if d[0] is not None} and len(seen) == 2 * 203
    for (p, _), pieces in seen.items():
        pieces.sort()
        assert [x[1] for x in pieces] == [k * cap[p] for k in range(len(pieces))]
        assert len(pieces) == 1 or all(x[2] == cap[p] for x in pieces[:-1])  # only what exceeds the capacity is divided
    f = {r.pack_id: r for r in fill(df, packs).collect()}
    assert f[2].containers <= f[2].least * 1.2 + 2
    assert packed(spark.createDataFrame([], "doc_id long, text string"), packs).count() == 0
    assert packed(spark.createDataFrame(docs, "doc_id long, text string"), packs.limit(0)).count() == 0


@needs_vocabulary
def test_large_capacities_and_many_packs(spark):
    docs = spark.createDataFrame([(k, "word " * (k % 40 + 1)) for k in range(120)], "doc_id long, text string")
    caps = {1: 1_000_000, 2: 64, **{k: 40 + k for k in range(3, 70)}}
    packs = spark.createDataFrame(list(caps.items()), "pack_id int, capacity_tokens int")
    rows = packed(docs, packs).collect()
    room = {}
    for r in rows:
        room[r.pack_id, r.container_id] = room.get((r.pack_id, r.container_id), 0) + r.n_tokens
    assert len({(r.pack_id, r.doc_id) for r in rows}) == 120 * len(caps)
    assert all(n <= caps[p] for (p, _), n in room.items()) and sum(p == 1 for p, _ in room) == 1
