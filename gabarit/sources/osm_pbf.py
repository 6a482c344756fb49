"""Nodes and ways of OSM extracts in PBF, read block by block on the executors.

The driver reads only the headers of the blocks and skips their bodies; each block is fetched, unpacked and parsed by a task, so that a
file of any size is spread. Positions of ways come by a join of node ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id long, ts long, tags map<string,string>, lon double, lat double"
WAYS = "way_id long, ts long, tags map<string,string>, nodes array<bigint>"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        out |= (c & 127) << shift
        i += 1
        if c < 128:
            return out, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers, or bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if key & 7 == 1 else 4
            v, i = b[i : i + n], i + n
        yield key >> 3, v


def _packed(b: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        v, i = _varint(b, i)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def _summed(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blocks(path: str) -> list[tuple[str, int, int]]:
    """(path, offset, size) of each data block, from the headers alone."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(int.from_bytes(head, "big"))))
            if header[1] == b"OSMData":
                out.append((path, f.tell(), header[3]))
            f.seek(header[3], 1)
    return out


def unpacked(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("a block is packed in a way that is not zlib")


def parse(block: bytes) -> tuple[list[tuple], list[tuple]]:
    """(nodes, ways) of one block, in the columns of NODES and WAYS."""
    strings, groups, grain, lat0, lon0, dategrain = [], [], 100, 0, 0, 1000
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k in (17, 18, 19, 20):
            grain, dategrain, lat0, lon0 = (v if k == 17 else grain, v if k == 18 else dategrain, v if k == 19 else lat0, v if k == 20 else lon0)
    degrees = lambda origin, v: (origin + grain * v) * 1e-9
    named = lambda ks, vs: {strings[k]: strings[v] for k, v in zip(ks, vs)}
    nodes, ways = [], []
    for group in groups:
        for k, v in fields(group):
            part: dict = {}
            for n, x in fields(v):
                part[n] = x
            if k == 1:  # a plain node
                info = dict(fields(part.get(4, b"")))
                zig = lambda z: (z >> 1) ^ -(z & 1)
                nodes.append((zig(part[1]), info.get(2, 0) * dategrain // 1000, named(_packed(part.get(2, b"")), _packed(part.get(3, b""))), degrees(lon0, zig(part[9])), degrees(lat0, zig(part[8]))))
            elif k == 2:  # dense nodes
                ids, lats, lons = (_summed(_packed(part.get(n, b""), True)) for n in (1, 8, 9))
                stamps = _summed(_packed(dict(fields(part.get(5, b""))).get(2, b""), True)) or [0] * len(ids)
                kv, at = _packed(part.get(10, b"")), 0
                for i, node in enumerate(ids):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    nodes.append((node, stamps[i] * dategrain // 1000, tags, degrees(lon0, lons[i]), degrees(lat0, lats[i])))
            elif k == 3:
                info = dict(fields(part.get(4, b"")))
                ways.append((part[1], info.get(2, 0) * dategrain // 1000, named(_packed(part.get(2, b"")), _packed(part.get(3, b""))), _summed(_packed(part.get(8, b""), True))))
    return nodes, ways


def read_pbf(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of extracts on a file system that all executors share."""
    found = [b for p in paths for b in blocks(p)]
    listed = spark.createDataFrame(found, "path string, at long, size long").repartition(max(1, min(len(found), 10_000)))

    def reader(which: int):
        columns = [c.split()[0] for c in (NODES, WAYS)[which].split(", ")]

        def run(batches):
            for pdf in batches:
                for path, at, size in pdf.itertuples(index=False):
                    with open(path, "rb") as f:
                        f.seek(at)
                        yield pd.DataFrame(parse(unpacked(f.read(size)))[which], columns=columns)

        return run

    return listed.mapInPandas(reader(0), NODES), listed.mapInPandas(reader(1), WAYS)


def located_ways(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """ways with coords (array of struct(x, y), in order); a node that is not in the extract leaves null positions."""
    spots = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id")).join(nodes.select("node_id", "lon", "lat"), "node_id", "left")
    coords = spots.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("c"))
    return ways.join(coords.select("way_id", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords")), "way_id", "left")
