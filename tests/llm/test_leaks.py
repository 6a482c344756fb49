import random
import re

import numpy as np
from pyspark.sql import functions as F

from gabarit.llm.leaks import common_subsequence, leaks, words_of

DOCS, ITEMS = "doc_id long, text string", "item_id long, suite string, question string, passage string, answer string"
WORDS = [f"w{k}" for k in range(60)] + ["Straße", "été", "7", "Ölfeld"]


def plain(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = set()
    for i, _, _, p, _ in items:
        w = plain(p)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for d, t in docs:
            v = plain(t)
            if d is not None and any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, "s", "q", " ".join(say(rng.choice([3, 11, 12, 40, 90]))), "w1") for k in range(40)] + [(98, "s", "q", None, None), (99, "s", "q", "", "")]
    docs = []
    for k in range(300):
        words = say(rng.choice([0, 5, 50, 400]))
        if rng.random() < 0.6:
            p = items[rng.randrange(40)][3].split()
            n = rng.choice([11, 12, 13, 30])
            a = rng.randrange(max(1, len(p) - n + 1))
            part = p[a : a + n]
            if rng.random() < 0.2:
                part = part[:6] + ["[Applause]"] + part[6:]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((k, rng.choice([" ", ", ", "\n", " — "]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(900, None), (901, ""), (902, " ".join(say(40_000)) + " " + items[3][3]), docs[0]]
    want = brute(docs, items)
    got = leaks(spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1)), spark.createDataFrame(items + items[:3], ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.verbatim} == want and len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_more_items_than_one_block(spark):
    items = [(k, "s", "q", " ".join(f"b{k}x{j}" for j in range(20)), "a") for k in range(300)]
    docs = [(k, "before " + items[k][3] + " after") for k in range(0, 300, 7)]
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(k, k) for k in range(0, 300, 7)}


def test_paraphrases_and_empty(spark):
    items = [(1, "s", "q", "the lateral registrar warned by letter that the tolls of the harbour paid for repair of towpath walls", "towpath walls")]
    docs = [(1, "Then the lateral registrar warned by letter so to speak that the tolls of the harbour indeed paid for repair, we hear, of towpath walls."), (2, "nothing of the kind")]
    got = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), paraphrases=True).collect()
    assert [(r.doc_id, r.verbatim, r.answered) for r in got] == [(1, False, True)]
    assert leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_paraphrases_against_brute_force(spark):
    rng = random.Random(5)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, "s", "q", " ".join(say(rng.choice([8, 30, 45, 60]))), f"answer {k % 7}") for k in range(30)]
    docs = []
    for k in range(200):
        words = [f"x{rng.randrange(900)}" for _ in range(rng.choice([0, 9, 50, 200]))]
        item = items[rng.randrange(30)]
        part = [w if j % rng.choice([3, 3, 4]) else "other" for j, w in enumerate(item[3].split())]  # hardly three words in a row are left
        at = rng.choice([0, len(words) // 16 * 16, len(words)])
        docs.append((k, " ".join(words[:at] + part + words[at:] + [item[4] if rng.random() < 0.7 else "none"])))
    want = {}
    for d, t in docs:
        v = words_of([t])[0]
        width = min(32, len(v))
        for i, _, _, p, a in items:
            w = words_of([p])[0]
            share = max(common_subsequence(w, v[s : s + width]) for s in {*range(0, len(v) - width + 1, 16), len(v) - width}) / min(len(w), width)
            if a in t and share >= 0.6:
                want[d, i] = share
    got = {(r.doc_id, r.item_id): r.share for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), paraphrases=True).collect() if not r.verbatim}
    assert len(want) > 50 and got == want


def test_words_and_subsequences():
    h, doc = words_of(["one two", "", "two, one-two"])
    assert doc.tolist() == [0, 0, 2, 2, 2] and h[1] == h[2] == h[4] and h[0] == h[3] != h[1]
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]
