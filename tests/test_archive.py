import random

import pytest
from pyspark.sql import functions as F
from terrane.sources import archive, tables

TILES = "z int, x long, y long, payload binary"


def hilbert(z, x, y):
    n, d, s = 1 << z, 0, 1 << z >> 1
    while s:
        right, up = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * right) ^ up)
        if not up:
            if right:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return (4**z - 1) // 3 + d


def test_numbers_follow_the_curve(spark):
    places = [(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)] + [(20, 12345, 999999), (26, (1 << 26) - 1, 0)]
    rows = spark.createDataFrame(places, "z int, x long, y long")
    got = {(r.z, r.x, r.y): r.i for r in rows.select("z", "x", "y", archive.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("i")).collect()}
    assert got == {p: hilbert(*p) for p in places}
    way = sorted((i, p) for p, i in got.items() if p[0] == 4)
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for (_, a), (_, b) in zip(way, way[1:]))
    with pytest.raises(Exception, match="no such tile"):
        spark.createDataFrame([(2, 4, 0)], "z int, x long, y long").select(archive.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()


def test_the_same_bytes_however_partitioned(spark):
    r = random.Random(7)
    places = [(z, x, y) for z in range(6) for x in range(1 << z) for y in range(1 << z) if r.random() < 0.8]
    tiles = [(*p, bytearray(r.choice((b"sea", b"sea", b"sea", b"land", b"", bytes([r.randrange(256)] * r.randrange(1, 9)))))) for p in places]
    r.shuffle(tiles)
    made = []
    for n in (2, 64):
        frame = spark.createDataFrame(tiles, TILES).repartition(n)
        found = archive.entries(frame)
        parts = {d.leaf: bytes(d.content) for d in archive.directories(found, leaf=100).collect()}
        data = b"".join(bytes(s.payload) for s in archive.stored(frame).orderBy("offset", F.length("payload")).collect())
        made.append((parts, data))
    assert made[0] == made[1]
    parts, data = made[0]
    root, leaves, looked = archive.entries_of(parts[None]), b"".join(parts[k] for k in sorted(k for k in parts if k is not None)), {}
    for first, run, offset, length in root:
        inner = archive.entries_of(leaves[offset : offset + length])
        assert run == 0 and inner[0][0] == first and len(inner) <= 100
        for t, n, o, size in inner:
            looked |= dict.fromkeys(range(t, t + n), data[o : o + size])
    assert looked == {hilbert(*t[:3]): bytes(t[3]) for t in tiles} and len(root) > 3 and data.count(b"sea") == 1
    with pytest.raises(Exception, match="repeated key"):
        archive.entries(spark.createDataFrame([*tiles, tiles[0]], TILES)).collect()


def test_numbers_of_any_length_and_no_tiles(spark):
    rows = [(5, 1, 0, 10), (300, 2, 10, 1 << 40), (1 << 50, 1, 7, 0)]
    assert archive.entries_of(archive.directory(rows)) == rows and archive.entries_of(archive.directory([])) == []
    none = archive.directories(archive.entries(spark.createDataFrame([], TILES))).collect()
    assert [(d.leaf, bytes(d.content)) for d in none] == [(None, b"\x00")]


def test_stacked_tiles_are_counted_in_one_entry(spark):
    r = random.Random(4)
    tiles = [(3, x, y, r.choice((b"a", b"bb", b"ccc"))) for x in range(8) for y in range(8) for _ in range(r.choice((1, 1, 1, 2, 3)))]
    tiles += [(3, 0, 0, b"bb"), (3, 0, 0, b"ccc"), (3, 0, 0, b"ccc")]  # two or more payloads have the same first tile
    places = {}
    for z, x, y, payload in tiles:
        places.setdefault(hilbert(z, x, y), []).append(payload)
    first = {p: min(i for i, of in places.items() if p in of) for p in {t[3] for t in tiles}}
    offset = {p: sum(len(q) for q in first if first[q] <= first[p]) - len(p) for p in first}
    want, last = [], None
    for i, of in sorted(places.items()):
        low, length = min(offset[p] for p in of), min(map(len, of))
        if len(of) == 1 and last == (i - 1, low):
            w = want[-1]
            want[-1] = (w[0], w[1] + 1, min(w[2], low), min(w[3], length))
        else:
            want.append((i, len(of), low, length))
        last = (i, max(offset[p] for p in of))
    got = archive.entries(spark.createDataFrame(tiles, TILES).repartition(5), stacked=True)
    assert sorted(map(tuple, got.collect())) == want and sum(w[1] for w in want) == len(tiles)


def test_more_rows_than_the_level_has(spark, tmp_path):
    """archive_entries as its SQL where the grid of parts wraps round."""
    import __spark_entry__ as contract
    import duckdb

    spark.range(0, 110_000, 1, 4).select(F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = contract.queries()["archive_entries"](spark, str(tmp_path)).select("tile_id", "run", "start", "length")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT tile_id, run, start, length FROM ({contract.oracle_sql()['archive_entries']})").fetchall())


def test_published_with_contracts_and_hashes(spark, tmp_path):
    import glob
    import os

    path, contract, grid = f"{tmp_path}/layer", {"kind": "amount", "statistic": "sum"}, {"level": 3}
    df = spark.range(100).select(F.col("id").alias("row"), (F.col("id") % 7).alias("value"), (F.col("id") % 2).alias("tile"))
    with pytest.raises(ValueError, match="not there: nothing"):
        tables.publish_with_manifest(df, path, {"nothing": contract})
    tables.publish_with_manifest(df.repartition(3), path, {"value": contract}, grid, "tile")
    back = spark.read.parquet(f"{path}/data")
    assert back.count() == 100 and tables.contract_of(back, "value") == contract and tables.contract_of(back, "row") is None
    assert back.schema["row"].metadata["grid"] == '{"level":3}'
    assert tables.unpublished(spark, path).count() == 0
    first, second, *_ = sorted(glob.glob(f"{path}/data/*/*.parquet"))
    os.rename(first, f"{os.path.dirname(first)}/other.parquet")
    for crc in glob.glob(f"{path}/data/*/.*.crc"):  # of the local file system, which would refuse to read it
        os.remove(crc)
    with open(second, "ab") as file:
        file.write(b"x")
    assert sorted(r.problem for r in tables.unpublished(spark, path).collect()) == ["differs", "missing", "unexpected"]
    with pytest.raises(Exception, match="already exists"):
        tables.publish_with_manifest(df, path, {})
