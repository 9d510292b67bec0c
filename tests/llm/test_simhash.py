import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import simhash as S


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    n = max(1, len(words) - 3) if words else 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(fps):
    at = list(range(len(fps)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints_match_plain():
    rng = random.Random(1)
    texts = ["", None, " \n", "A", "a b C", "É b c d", "x\x85y z w q"] + [" ".join(rng.choice("abcDE\x1cé") for _ in range(n)) for n in (3, 4, 5, 300, 2000)]
    got = S.fingerprints_of([(t or "").encode() for t in texts])
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_links_match_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(30)], np.uint64))
    cells = np.array([len(fps) - 500, 1, 499])
    got = {(int(i), int(j)) for a, b in S.links(fps, cells) for i, j in zip(a, b)}
    bounds = np.append(0, np.cumsum(cells))
    want = {(i, j) for s, e in zip(bounds, bounds[1:]) for i in range(s, e) for j in range(i + 1, e) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want and want


def test_bands_lose_no_link():
    rng = random.Random(8)
    for blocks in S.BLOCKS:
        own = [m % 2**64 for m in S.masks(blocks)]
        for _ in range(500):
            apart = sum(1 << k for k in rng.sample(range(64), 4))
            assert any(m & apart == 0 for m in own)
    assert [S.blocks_for(n) for n in (0, 10**8, 10**9, 10**10, 10**11, 10**13)] == [6, 6, 7, 7, 8, 8]


@pytest.mark.parametrize("blocks", S.BLOCKS)
def test_near_duplicates_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(S, "CELL", 7)  # cells in parts
    rng = random.Random(5)
    base = [[rng.choice("the of and to in a is it on as be".split()) + str(rng.randrange(90)) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = "x" + str(rng.randrange(9))
        rows.append((1000 - i, " ".join(words)))
    rows += [(3, None), (4, ""), (4, ""), (5, " "), (6, "one"), (None, "one"), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min((x for x in (d, least.get(c)) if x is not None), default=None)
    assert got == sorted(((d, f, least[c]) for (d, _), f, c in zip(rows, fps, comp)), key=str)
    assert len(set(comp)) < len(rows) - 40


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_huge_component_is_split(spark, monkeypatch):
    """The joins of the components' steps take the rows of a hot node apart."""
    from pagequarry.llm import common

    conf = {
        "spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before, split, write = {k: spark.conf.get(k, None) for k in conf}, [], common.materialize

    def watched(df):
        df.collect()
        split.append(df._jdf.queryExecution().executedPlan().toString().count("skew=true"))
        return write(df)

    monkeypatch.setattr(common, "materialize", watched)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = spark.range(1, 100_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        assert common.connected_components(star).groupBy("component").count().collect() == [(0, 100_000)]
        assert max(split) > 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
