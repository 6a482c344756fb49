"""Filling containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Only the number of documents of each size matters to the packing, and there are no more sizes than the capacity has tokens. So the
sizes are counted by the cluster, the packing is solved on the counts, and every document finds its container from its rank among those
of its size. Method: documents above a third of the capacity are matched greedily, the largest with the largest that still fits, at most two
to a container; then the smaller ones, largest first, go where the least room is left that still holds them (best fit), all of
a size at a time.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gabarit.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut before the byte pairs are merged, as published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = 100_000  # documents that one task ranks


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): tokens of each whole text; 0 for a null or empty text. Repeated doc_ids count once, by their longest text; null doc_ids are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    counted = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def solve(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Kinds of container as (how many, {size: items of that size in each}) for items of sizes 1 to capacity.

    Each item is in one container, none holds more than its capacity; ties between containers of equal room go to the one opened first.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("a size is not between 1 and the capacity")
    kinds: list[list] = []  # [how many, content]
    rooms: list[tuple[int, int]] = []  # (room, kind), sorted

    def open_(n: int, content: dict[int, int]) -> None:
        if n:
            kinds.append([n, content])
            insort(rooms, (capacity - sum(s * k for s, k in content.items()), len(kinds) - 1))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            open_(left[a], {a: 1})
            large.pop()
            continue
        b = large[at]
        if a == b:
            open_(left[a] // 2, {a: 2})
            open_(left[a] % 2, {a: 1})
            large.pop()
            continue
        n = min(left[a], left[b])
        open_(n, {a: 1, b: 1})
        for s in (a, b):
            left[s] -= n
            if not left[s]:
                large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(rooms, (s, -1))
            if at == len(rooms):
                each = capacity // s
                open_(n // each, {s: each})
                open_(1 if n % each else 0, {s: n % each})
                break
            room, k = rooms.pop(at)
            many, content = kinds[k]
            each = room // s
            full, rest = (many, 0) if n >= each * many else (n // each, n % each)
            kinds[k][0] = 0
            open_(full, content | {s: each})
            open_(1 if rest else 0, content | {s: rest})
            open_(many - full - (1 if rest else 0), content)
            n -= full * each + rest
    return [(n, c) for n, c in kinds if n]


def places(kinds: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int]]:
    """(size, first rank, first container, items of the size in each), in the order of size and rank: where the items of each size go."""
    out, seen, base = [], {}, 0
    for n, content in kinds:
        for s, k in content.items():
            out.append((s, seen.get(s, 0), base, k))
            seen[s] = seen.get(s, 0) + n * k
        base += n
    return sorted(out)


def packed(documents: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_id, container_id, doc_id, piece, first_token, n_tokens): every text, once for each pack, in containers of capacity_tokens.

    A text that alone exceeds the capacity is cut into pieces of the capacity, each in a container of its own (named by the document), and a
    rest that is packed like a text. Texts without tokens are in container m0. Packs without a positive capacity are left out, repeated ones
    count once. What the driver holds is bounded by the capacities: a count for each size up to them, and the kinds of container.
    """
    spark = documents.sparkSession
    caps = sorted({(r["pack_id"], r["capacity_tokens"]) for r in packs.select("pack_id", "capacity_tokens").distinct().collect() if r["pack_id"] is not None and (r["capacity_tokens"] or 0) > 0})
    sizes = materialize(token_counts(documents, vocabulary), "sizes")
    pack = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("cap")) for p, c in caps])) if caps else None
    schema = "pack_id int, container_id string, doc_id long, piece long, first_token long, n_tokens long"
    if not caps:
        return spark.createDataFrame([], schema)
    total = sizes.count()
    salts = max(1, -(-total // GROUP))
    items = sizes.select("doc_id", "n_tokens", pack.alias("p")).select("doc_id", "p.*", F.expr("n_tokens div p.cap").alias("whole"), (F.col("n_tokens") % F.col("p.cap")).alias("rest"))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    by_salt = materialize(items.filter("rest > 0").groupBy("pack_id", "rest", "salt").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    counts: dict[int, dict[int, int]] = {p: {} for p, _ in caps}
    for r in by_salt.groupBy("pack_id", "rest").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        counts[r["pack_id"]][r["rest"]] = r["n"]
    tables = []  # of each pack: where the places of a size begin, their first ranks, first containers, and items in each
    for p, c in caps:
        at = np.array(places(solve(counts[p], c)), dtype=np.int64).reshape(-1, 4)
        tables.append((np.searchsorted(at[:, 0], np.arange(c + 2)), at[:, 1], at[:, 2], at[:, 3]))
    shared = spark.sparkContext.broadcast(tables)
    numbered = F.create_map(*[x for i, (p, _) in enumerate(caps) for x in (F.lit(p).cast("int"), F.lit(i))])

    @F.pandas_udf("long")
    def container(pack: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        pack, size, rank = (x.to_numpy(np.int64) for x in (pack, size, rank))
        out = np.zeros(len(pack), np.int64)
        for i in np.unique(pack):
            begin, first, base, each = shared.value[i]
            mine = np.flatnonzero(pack == i)
            for s in np.unique(size[mine]):  # the places of a size lie together, by rank
                own = mine[size[mine] == s]
                at = begin[s] + np.searchsorted(first[begin[s] : begin[s + 1]], rank[own], side="right") - 1
                out[own] = base[at] + (rank[own] - first[at]) // each[at]
        return pd.Series(out)

    before = Window.partitionBy("pack_id", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = by_salt.select("pack_id", "rest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("pack_id", "rest", "salt").orderBy("doc_id")
    rests = items.filter("rest > 0").withColumn("rn", F.row_number().over(within) - 1).join(offset, ["pack_id", "rest", "salt"])
    rests = rests.withColumn("nr", container(numbered[F.col("pack_id")], F.col("rest"), F.col("before") + F.col("rn")))
    rests = rests.select("pack_id", F.concat(F.lit("m"), F.col("nr")).alias("container_id"), "doc_id", F.col("whole").alias("piece"), (F.col("whole") * F.col("cap")).alias("first_token"), F.col("rest").alias("n_tokens"))
    wholes = items.filter("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    wholes = wholes.select("pack_id", F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), F.col("piece")).alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.col("cap").alias("n_tokens"))
    empty = items.filter("whole = 0 AND rest = 0").select("pack_id", F.lit("m0").alias("container_id"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"))
    return rests.unionByName(wholes).unionByName(empty)


def fill(assigned: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_id, containers, tokens, least, free_share): least: the containers that the tokens need at least."""
    used = assigned.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    out = used.join(packs.select("pack_id", "capacity_tokens").distinct(), "pack_id")
    room = F.col("containers") * F.col("capacity_tokens")
    return out.select("pack_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (1 - F.col("tokens") / room).alias("free_share"))
