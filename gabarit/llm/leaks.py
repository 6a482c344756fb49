"""Test passages in documents: latent semantic retrieval, then exact checks; paraphrases by exact bounds.

1. Features are the three-word shingles of the test passages, weighted by their rarity over all documents (a pass over the corpus).
2. For each block of test items a randomised SVD of their TF-IDF rows gives a latent space; its rank is that of the block, so that the
   space holds every passage and a cosine in it is never below the plain cosine.
3. Every document is cut into passages of 32 words, each beginning 16 words after the last; passages with any feature are folded into the
   space, and items within a cosine are candidates. A run of 12 words lies in one passage whole, and brings 10 features of the item.
4. Candidates are checked for a run of 12 words in common.
5. Paraphrases may share no three words in a row, so they are not sought in the space: of each document that holds an item's answer,
   every passage with enough of the item's words, in any order, is checked for the longest common subsequence. Nothing that passes is missed.

Words are hashed as whole arrays of characters, never one by one. Nothing is shuffled but counts and results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
SHINGLE = 3
WIDTH, STEP = 32, 16
COSINE = 0.08
PARAPHRASE_SHARE = 0.6
BLOCK = 256  # items of one latent space
BLOCKS_AT_ONCE = 4  # spaces that the executors hold at once; more blocks take more passes over the documents
CHUNK = 1 << 19  # characters hashed at once

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _is_word(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter or a digit; only the code points that occur are looked up."""
    import unicodedata

    table = np.bincount(codes).astype(bool) if len(codes) else np.zeros(1, bool)
    for c in np.flatnonzero(table).tolist():
        kind = unicodedata.category(chr(c))
        table[c] = kind[0] == "L" or kind == "Nd"
    return table[codes]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, doc): the hash of each word of the texts, in order, and the index of its text. Words: runs of letters and digits, without case."""
    text = "\n".join(texts)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate([[False], _is_word(codes), [False]])
    edge = np.diff(inside.astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(codes), _P))])
        inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(codes), _P_INV))])
        total = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        h = _mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return h, np.searchsorted(ends, start, side="right")


def runs_of(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n words in a row, whether all are of one text), by the place of the first word; n - 1 places shorter."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = out * _P + h[k : k + m]
        return _mix(out), doc[:m] == doc[n - 1 :]


def chunks(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    """ids and lower-cased texts, some CHUNK characters at a time, no text divided; null and empty texts left out."""
    i, t, size = [], [], 0
    for a, b in zip(ids, texts):
        if b:
            i.append(a)
            t.append(b.lower())
            size += len(b)
            if size >= CHUNK:
                yield i, t
                i, t, size = [], [], 0
    if i:
        yield i, t


def _features(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sorted features, row, column of each occurrence, word hashes of each item) of items' passages."""
    texts = [(p or "").lower() for p in pdf["passage"]]
    h, doc = words_of(texts)
    g, ok = runs_of(h, doc, SHINGLE)
    rows, g = doc[: len(g)][ok], g[ok]
    feats = np.unique(g)
    return feats, rows, np.searchsorted(feats, g), [h[doc == k] for k in range(len(texts))]


def document_frequencies(documents: DataFrame, feats: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents with each feature, documents), over all documents. feats: sorted, of the test items only."""
    shared = documents.sparkSession.sparkContext.broadcast(feats)

    def count(batches):
        f = shared.value
        df, n = np.zeros(len(f), np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for _, texts in chunks(list(pdf["doc_id"]), list(pdf["text"])):
                h, doc = words_of(texts)
                g, ok = runs_of(h, doc, SHINGLE)
                if not len(f) or not len(g):
                    continue
                at = np.minimum(np.searchsorted(f, g), len(f) - 1)
                hit = np.flatnonzero(ok & (f[at] == g))
                df += np.bincount(np.unique(doc[hit].astype(np.int64) * len(f) + at[hit]) % len(f), minlength=len(f))
        some = np.flatnonzero(df)
        yield pd.DataFrame({"feature": np.append(some, -1), "n": np.append(df[some], n)})

    rows = documents.select("doc_id", "text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(len(feats), np.int64), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, n


def latent_space(items: DataFrame, idf_of: tuple[np.ndarray, np.ndarray]) -> list[dict]:
    """A space for each block of items: by randomised SVD on the executors, one task a block. idf_of: (sorted features, weights)."""
    shared = items.sparkSession.sparkContext.broadcast(idf_of)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        all_feats, all_idf = shared.value
        feats, row, col, words = _features(pdf)
        idf = all_idf[np.searchsorted(all_feats, feats)]
        n, m = len(pdf), len(feats)
        a = np.zeros((n, max(m, 1)), np.float32)
        np.add.at(a, (row, col), idf[col])
        rank = min(n, max(m, 1))
        omega = np.random.default_rng(5).standard_normal((a.shape[1], rank + 8)).astype(np.float32)
        q = np.linalg.qr(a @ omega)[0]
        for _ in range(2):  # power iterations
            q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
        vt = np.linalg.svd(q.T @ a, full_matrices=False)[2][:rank]
        z = a @ vt.T
        runs = []
        for k, w in enumerate(words):
            g, _ok = runs_of(w, np.zeros(len(w), np.int64), RUN)
            runs.append(np.unique(g))
        joined = np.concatenate([np.stack([r, np.full(len(r), k, np.uint64)], 1) for k, r in enumerate(runs)]) if runs else np.zeros((0, 2), np.uint64)
        return pd.DataFrame({
            "items": [pdf["item_id"].to_numpy(np.int64).tobytes()], "feats": [feats.tobytes()], "idf": [idf.astype(np.float32).tobytes()], "rank": [rank],
            "v": [np.ascontiguousarray(vt.T[:m], dtype=np.float32).tobytes()], "z": [z.astype(np.float32).tobytes()], "runs": [joined.astype(np.uint64).tobytes()],
            "words": [np.concatenate([*words, np.zeros(0, np.uint64)]).tobytes()], "ends": [np.cumsum([len(w) for w in words]).astype(np.int64).tobytes()],
        })

    schema = "items binary, feats binary, idf binary, rank int, v binary, z binary, runs binary, words binary, ends binary"
    got = items.groupBy("block").applyInPandas(lambda pdf: fit(pdf), schema).collect()  # bounded by the test items
    out = []
    for r in got:
        z = np.frombuffer(r["z"], np.float32).reshape(-1, r["rank"])
        runs = np.frombuffer(r["runs"], np.uint64).reshape(-1, 2)
        words, ends = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["ends"], np.int64)
        with np.errstate(over="ignore"):
            key = np.sort(runs[:, 0] ^ _mix(runs[:, 1] + np.uint64(77)))
        out.append({
            "items": np.frombuffer(r["items"], np.int64), "feats": np.frombuffer(r["feats"], np.uint64), "idf": np.frombuffer(r["idf"], np.float32),
            "v": np.frombuffer(r["v"], np.float32).reshape(-1, r["rank"]), "z": z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), "runs": key,
            "words": (own := [words[a:b] for a, b in zip([0, *ends[:-1]], ends)]), "vocabulary": [np.unique(w, return_counts=True) for w in own],
        })
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the bits of one whole number as the row of the table."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        u = row & places.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def search(space: dict, h: np.ndarray, doc: np.ndarray, shares: bool) -> Iterator[tuple[int, int, float, bool, float]]:
    """(text, item, cosine, verbatim, share) of the verbatim passages of one space in hashed texts; share: of the passage's words in a common subsequence, where asked for."""
    f = space["feats"]
    g, ok = runs_of(h, doc, SHINGLE)
    if not len(f) or not len(g):
        return
    at = np.minimum(np.searchsorted(f, g), len(f) - 1)
    hit = np.flatnonzero(ok & (f[at] == g))
    if not len(hit):
        return
    first = np.searchsorted(doc, np.arange(doc[-1] + 1))
    place = hit - first[doc[hit]]
    # a shingle is in the passage that begins last before it, and in the one before that if it fits there
    pieces = place // STEP
    win = np.concatenate([pieces, pieces - 1])
    src = np.concatenate([np.arange(len(hit))] * 2)
    fits = (win >= 0) & (place[src] + SHINGLE <= win * STEP + WIDTH)
    win, src = win[fits], src[fits]
    begin = first[doc[hit[src]]] + win * STEP
    order = np.argsort(begin, kind="stable")
    begin, src = begin[order], src[order]
    starts, cut = np.unique(begin, return_index=True)
    feats = at[hit[src]]
    r12, ok12 = runs_of(h, doc, RUN)
    for lo in range(0, len(starts), 4096):
        hi = min(lo + 4096, len(starts))
        a, b = cut[lo], cut[hi] if hi < len(starts) else len(feats)
        z = np.add.reduceat(space["v"][feats[a:b]] * space["idf"][feats[a:b], None], cut[lo:hi] - a, axis=0)
        cos = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)) @ space["z"].T
        w, item = np.nonzero(cos >= COSINE)
        s = starts[lo:hi][w]
        offs = s[:, None] + np.arange(WIDTH - RUN + 1)[None, :]
        legal = offs < len(r12)
        offs = np.where(legal, offs, 0)
        verbatim = np.zeros(len(s), bool)
        if len(r12) and len(space["runs"]):
            with np.errstate(over="ignore"):
                key = r12[offs] ^ _mix(item.astype(np.uint64) + np.uint64(77))[:, None]
            there = np.minimum(np.searchsorted(space["runs"], key), len(space["runs"]) - 1)
            verbatim = ((space["runs"][there] == key) & legal & ok12[offs] & (doc[offs] == doc[s][:, None])).any(axis=1)
        for k in np.flatnonzero(verbatim):
            share = 0.0
            if shares:
                d = doc[s[k]]
                stop = min(s[k] + WIDTH, first[d + 1] if d + 1 < len(first) else len(h))
                share = common_subsequence(space["words"][item[k]], h[s[k] : stop]) / max(1, min(len(space["words"][item[k]]), stop - s[k]))
            yield int(doc[s[k]]), int(item[k]), float(cos[w[k], item[k]]), bool(verbatim[k]), share


def _cosine(space: dict, h: np.ndarray, item: int) -> float:
    """Cosine in the space of one passage, as words, with an item; 0 without a common feature."""
    f, g = space["feats"], runs_of(h, np.zeros(len(h), np.int64), SHINGLE)[0]
    at = np.searchsorted(f, g[np.isin(g, f)])
    z = (space["v"][at] * space["idf"][at, None]).sum(axis=0)
    return float(z @ space["z"][item] / max(float(np.linalg.norm(z)), 1e-9))


def paraphrased(space: dict, h: np.ndarray, doc: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, float, bool, float]]:
    """(text, item, cosine, False, share) of the best passage of each text that holds an item's answer, where its share is enough.

    A common subsequence is no longer than the words in common, each as often as both have it: passages with too few are left out
    unchecked, no others. The last passage ends with its text, and is as wide as the others unless the text is shorter.
    """
    by_answer: dict[str, list[int]] = {}
    for k, answer in enumerate(space["answers"]):
        if answer and len(space["words"][k]) >= SHINGLE:
            by_answer.setdefault(answer, []).append(k)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d, text in enumerate(texts):
        own = h[bounds[d] : bounds[d + 1]]
        held = [k for answer, items in by_answer.items() if answer in text for k in items]
        if not held or not len(own):
            continue
        width = min(WIDTH, len(own))
        starts = np.unique(np.append(np.arange(0, len(own) - width + 1, STEP), len(own) - width))
        for k in held:
            words, (known, often) = space["words"][k], space["vocabulary"][k]
            whole = min(len(words), width)
            need = PARAPHRASE_SHARE * whole - 1e-9
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            at = np.where(known[at] == own, at, -1)
            upto = np.concatenate([[0], np.cumsum(at >= 0)])
            some = starts[upto[starts + width] - upto[starts] >= need]
            if not len(some):
                continue
            rows = np.sort(at[some[:, None] + np.arange(width)], axis=1)
            place = np.arange(width)
            begins = np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1)
            nth = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
            some = some[((rows >= 0) & (nth < often[rows])).sum(axis=1) >= need]
            best, where = max(((common_subsequence(words, own[s : s + width]), -int(s)) for s in some), default=(0, 0))
            if best >= need:
                yield d, k, _cosine(space, own[-where : width - where], k), False, best / whole


def leaks(documents: DataFrame, items: DataFrame, paraphrases: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, verbatim, share, answered): documents with passages of test items, each pair once.

    verbatim: RUN words in a row in common. With paraphrases also all pairs whose best passage has at least PARAPHRASE_SHARE of its words
    in a common subsequence with the item's and whose document holds the item's answer; their cosine may be 0. Null and empty texts, and items of fewer words than a
    shingle, have no pairs; repeated documents and items count once. Documents of any length are searched whole.
    """
    spark = documents.sparkSession
    # the test items are the query set of the search: they are held in blocks, the documents never
    pdf = items.filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).groupBy("item_id").agg(F.max_by(F.struct("passage", "answer"), F.struct(F.length("passage"), "passage")).alias("p"))
    pdf = pdf.select("item_id", "p.*").orderBy("item_id").toPandas()
    schema = "doc_id long, item_id long, cosine double, verbatim boolean, share double, answered boolean"
    if pdf.empty:
        return spark.createDataFrame([], schema)
    pdf["block"] = np.arange(len(pdf)) // BLOCK
    feats = _features(pdf)[0]
    df, n = document_frequencies(documents, feats)
    idf = 1.0 + np.log((n + 1.0) / (df + 1.0))
    spaces = latent_space(spark.createDataFrame(pdf[["item_id", "passage", "block"]]), (feats, idf))
    answers = {int(i): (a or "").lower() for i, a in zip(pdf["item_id"], pdf["answer"])}
    out = None
    for lo in range(0, len(spaces), BLOCKS_AT_ONCE):
        part = [s | {"answers": [answers[int(i)] for i in s["items"]]} for s in spaces[lo : lo + BLOCKS_AT_ONCE]]
        shared = spark.sparkContext.broadcast(part)

        def find(batches, shared=shared):
            for batch in batches:
                best: dict[tuple[int, int], list] = {}
                for ids, texts in chunks(list(batch["doc_id"]), list(batch["text"])):
                    h, doc = words_of(texts)
                    if not len(h):
                        continue
                    for space in shared.value:
                        for d, i, cos, verbatim, share in chain(search(space, h, doc, paraphrases), paraphrased(space, h, doc, texts) if paraphrases else ()):
                            answer = space["answers"][i]
                            row = [cos, verbatim, share, bool(answer) and answer in texts[d]]
                            key = (int(ids[d]), int(space["items"][i]))
                            old = best.get(key)
                            best[key] = row if old is None else [max(x, y) for x, y in zip(old, row)]
                rows = [(d, i, *r) for (d, i), r in best.items() if r[1] or (paraphrases and r[2] >= PARAPHRASE_SHARE and r[3])]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "verbatim", "share", "answered"])

        one = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(find, schema)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("verbatim").alias("verbatim"), F.max("share").alias("share"), F.max("answered").alias("answered"))
