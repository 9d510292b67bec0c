"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

The score of two rows is the integer inner product of their vectors, each component x taken
as floor(256 * x). Vectors are augmented by their norms, so that the largest products become
the smallest distances: with M the largest norm of all rows, a row x becomes
(x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0); then |a' - x'|^2 = M^2 + |a|^2 - 2 a.x.

Pivots are rows of least hash; every row lies in the cell of its nearest pivot, and so does
every anchor. The join of anchors and rows runs in two rounds. In the first, each cell's
anchors meet the rows of that cell only, which gives each anchor a score that its last
neighbour must reach at least, and so each cell of anchors a radius: the largest distance at
which a row can still serve one of them. In the second round a row of another cell goes to
a cell of anchors only if its distance to that pivot, less the distance of the cell's
farthest anchor, is within the radius (triangle inequality). Both rounds are exact inside a
group, and the groups' partial lists are merged by rank. Positives (same label) and
negatives (other labels, scores in a band below each positive) are such joins, one after
the other; for positives a row only goes to cells with an anchor of its label.

No group grows with the data: anchors of a cell are cut into blocks of ANCHOR_ROWS and its
rows into chunks of ROWS by hashes of their keys, by counts of the cells, so neither a hot
cell, a hot label nor many copies of one vector meet in one task. Pivots (at most PIVOTS)
and one line for each cell are all that the driver holds. Where the vectors have no clusters
nothing can be pruned and all rows meet all blocks of anchors, which costs what exhaustive
comparison does.

Odd rows: rows with a null id, label or vector, or any null or non-finite component, take no
part, nor do rows whose products could pass a long (a component of 2**23 or more in size, or an
integer vector with a squared norm of 2**62 or more). Rows alike in id, label and vector are one row; other rows that share an id are rows of
their own, also to each other, and ties among them go by label, then by a hash of the vector.
Vectors of different lengths are compared over the shorter one, as if filled up with zeros; an
empty vector scores 0. Very long vectors are bounded by Arrow batches. An empty table gives
an empty result. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, map_batches, materialize, small_side

POSITIVES, NEGATIVES = 5, 10
BAND = (30, 90)  # percent of the positive's score between which a negative's lies
PIVOTS = 256
ANCHOR_ROWS, ROWS = 4096, 4096  # of a block of anchors and of a chunk of rows
SLICE = 128  # anchors whose scores stand in memory at once
LARGEST, LARGEST_SQUARE = 2.0**23, 2.0**62  # of a component, and of an integer vector's squared norm

_ROW = "key long, vec_id long, label long, vec array<int>"
_FOUND = "akey long, anchor_id long, alabel long, key long, vec_id long, label long, pscore long, pkey long, positive_id long, score long"


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """key, vec_id, label and integer vector of each different row that takes part; key is a hash of the three."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))  # false for NaN and infinity, which Spark orders above all numbers
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    own = own.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * 256).cast("int")).alias("vec")).where(_square("vec") < LARGEST_SQUARE)
    return own.select(F.xxhash64("vec_id", "label", "vec").alias("key"), "vec_id", "label", "vec").dropDuplicates(["key", "vec_id", "label"])


def _square(vec: str) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of the list column as doubles, filled up with zeros, or cut to width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), max(sizes.max(initial=0), 1)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    if width is None or width == out.shape[1]:
        return out
    return out[:, :width] if width < out.shape[1] else np.pad(out, ((0, 0), (0, width - out.shape[1])))


def _distances(x: np.ndarray, height: np.ndarray, pivots: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Of augmented rows to augmented pivots."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T + (height[:, None] - heights) ** 2
    return np.sqrt(np.maximum(square, 0))


class Cells:
    """Pivots of the augmented space; norm is the largest of all rows."""

    def __init__(self, pivots: list[list[int]], norm: float):
        self.norm, width = norm, max([1, *map(len, pivots)])
        self.pivots = np.array([p + [0] * (width - len(p)) for p in pivots], float).reshape(-1, width)
        self.heights = self.height(self.pivots)

    def height(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))

    def to(self, vec: pa.Array, anchors: bool) -> np.ndarray:
        x = _matrix(vec)
        pivots = self.pivots
        if x.shape[1] != pivots.shape[1]:
            width = max(x.shape[1], pivots.shape[1])
            x, pivots = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, pivots))
        return _distances(x, np.zeros(len(x)) if anchors else self.height(x), pivots, self.heights)


def _placed(rows: DataFrame, cells: Cells, anchors: bool) -> DataFrame:
    """Rows with their cell and their distance to its pivot."""

    def f(batch: pa.RecordBatch) -> dict:
        d = cells.to(batch.column("vec"), anchors)
        cell = d.argmin(1)
        return {n: batch.column(n) for n in batch.schema.names} | {"cell": cell.astype("int32"), "far": d[np.arange(len(d)), cell]}

    return map_batches(rows, f, f"{_extra(rows)}, cell int, far double")


def _extra(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def _served(rows: DataFrame, cells: Cells, reach: dict[int, float] | None = None) -> DataFrame:
    """Rows of other cells, once for each cell of anchors that they might serve: group is that cell.

    The reach of each cell is given, or else in the rows' own column need, of cells and reaches."""
    slack = 1e-6 * (cells.norm + 1)
    all_cells, all_reach = np.array(list(reach or {}), int), np.array(list((reach or {}).values()), float)

    def f(batch: pa.RecordBatch) -> dict:
        d = cells.to(batch.column("vec"), False)
        if reach is None:
            need = batch.column("need")
            at = np.repeat(np.arange(len(d)), np.diff(need.offsets.to_numpy()))
            cell, limit = (need.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("cell", "reach"))
        else:
            at, cell, limit = np.repeat(np.arange(len(d)), len(all_cells)), np.tile(all_cells, len(d)), np.tile(all_reach, len(d))
        hit = (d[at, cell] <= limit + slack) & (np.asarray(batch.column("cell"))[at] != cell)
        at = pa.array(at[hit])
        return {n: batch.column(n).take(at) for n in ("key", "vec_id", "label", "vec")} | {"group": cell[hit].astype("int32")}

    return map_batches(rows, f, f"{_ROW}, group int")


def _integers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products: by doubles if no sum can pass 2^53, else by longs."""
    width = min(x.shape[1], y.shape[1])
    x, y = x[:, :width], y[:, :width]
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * width < 2.0**53:
        return (x @ y.T).astype("int64")
    return x.astype("int64") @ y.T.astype("int64")


def _top(score: np.ndarray, most: int) -> np.ndarray:
    """Positions of the largest scores, of ties the first; score is in the order of ids."""
    if len(score) > 4 * most:
        least = np.partition(score, len(score) - most)[len(score) - most]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")][:most]


def _join(anchors: pa.Table, rows: pa.Table, positives: int, negatives: int, band: tuple[int, int]) -> pa.Table:
    """The best rows of one chunk for each anchor of one block: of its label, or below each positive that it carries."""
    if not len(anchors) or not len(rows):
        return pa.table({f.split()[0]: pa.array([], pa.int64()) for f in _FOUND.split(", ")})
    rows = rows.sort_by([("vec_id", "ascending"), ("label", "ascending"), ("key", "ascending")])
    x, y = _matrix(anchors["vec"]), _matrix(rows["vec"])
    key, ids, label = (rows[n].to_numpy() for n in ("key", "vec_id", "label"))
    akey, aid, alabel = (anchors[n].to_numpy() for n in ("key", "vec_id", "label"))
    wanted = anchors["wanted"].to_pylist() if "wanted" in anchors.column_names else None
    out: list[tuple] = []
    for k in range(0, len(x), SLICE):
        for i, score in enumerate(_integers(x[k : k + SLICE], y), k):
            same = label == alabel[i]
            if wanted is None:
                at = np.flatnonzero(same & ((key != akey[i]) | (ids != aid[i])))
                out += [(akey[i], aid[i], alabel[i], key[j], ids[j], label[j], None, None, None, score[j]) for j in at[_top(score[at], positives)]]
                continue
            other = np.flatnonzero(~same)
            for w in wanted[i]:
                low, high = -(-band[0] * w["pscore"] // 100), band[1] * w["pscore"] // 100
                at = other[(score[other] >= max(low, w["floor"] if w["floor"] is not None else low)) & (score[other] <= high)]
                out += [(akey[i], aid[i], alabel[i], key[j], ids[j], label[j], w["pscore"], w["pkey"], w["positive_id"], score[j]) for j in at[_top(score[at], negatives)]]
    names = [f.split()[0] for f in _FOUND.split(", ")]
    return pa.table({n: pa.array([r[c] if r[c] is None else int(r[c]) for r in out], pa.int64()) for c, n in enumerate(names)})


def _met(anchors: DataFrame, rows: DataFrame, positives: int, negatives: int, band: tuple[int, int]) -> DataFrame:
    """Partial lists of anchors(cell) and rows(group) that meet: blocks by chunks, by counts of each cell."""
    spark = anchors.sparkSession
    count = lambda df, c, size: {r[0]: -(-r[1] // size) for r in df.groupBy(c).count().collect()}  # noqa: E731  one line for each pivot at most
    blocks, chunks = count(anchors, "cell", ANCHOR_ROWS), count(rows, "group", ROWS)
    both = [(j, blocks[j], chunks[j]) for j in blocks if j in chunks]
    if not both:
        return spark.createDataFrame([], _FOUND)
    parts = F.broadcast(spark.createDataFrame(both, "cell int, blocks int, chunks int"))
    share = lambda c, n: F.pmod(F.xxhash64(F.lit(7), "key"), F.col(n)).cast("int").alias(c)
    spread = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    left = anchors.join(parts, "cell").select("key", "vec_id", "label", "vec", *[c for c in ("wanted",) if c in anchors.columns], "cell", share("block", "blocks"), spread("chunks", "chunk"))
    right = rows.withColumnRenamed("group", "cell").join(parts, "cell").select("key", "vec_id", "label", "vec", "cell", share("chunk", "chunks"), spread("blocks", "block"))
    on = ["cell", "block", "chunk"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(lambda a, b: _join(a, b, positives, negatives, band), _FOUND)


def _best(found: DataFrame, most: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "label", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _reach(floors: DataFrame, norm: float, *by: str) -> DataFrame:
    """For each cell of anchors(cell, far, square, floor) how far from its pivot a row can lie and still score an anchor's floor; no floor, no limit."""
    need = F.sqrt(F.greatest(F.lit(norm**2) + F.col("square") - 2 * F.col("floor"), F.lit(0.0)))
    return floors.groupBy(*by, "cell").agg(F.max(F.col("far") + F.coalesce(need, F.lit(float("inf")))).alias("reach"))


def hard_negatives(
    rows: DataFrame,
    anchor_every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
    pivots: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is a multiple of anchor_every. Their positives are the first
    rows of their label by score, then by id; of each pair the first rows of other labels with
    band[0] percent of the positive's score at least and band[1] at most. pivots: a quarter of
    the root of the number of anchors, PIVOTS at most, unless given; it changes no result.
    """
    data = materialize(bounded(vectors(rows, id_col, vector_col, label_col)))
    spark, square = data.sparkSession, _square("vec")
    is_anchor = F.pmod("vec_id", F.lit(anchor_every)) == 0
    n, norm = data.agg(F.count(F.when(is_anchor, 1)), F.sqrt(F.max(square))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    picked = data.orderBy(F.xxhash64(F.lit(3), "key"), "key", "vec_id").select("vec").limit(pivots or min(PIVOTS, math.ceil(n**0.5 / 4)))
    cells = Cells([r[0] for r in picked.collect()], float(norm))
    placed = materialize(_placed(data, cells, False))
    anchors = materialize(_placed(data.where(is_anchor).withColumn("square", square), cells, True))
    near, me = placed.withColumnRenamed("cell", "group").drop("far"), ["akey", "anchor_id"]
    named = anchors.withColumnsRenamed({"key": "akey", "vec_id": "anchor_id"})

    first = materialize(_met(anchors, near, positives, negatives, band))
    floor = _best(first, positives, *me).groupBy(*me).agg(F.when(F.count("*") >= positives, F.min("score")).alias("floor"))
    need = _reach(named.join(floor, me, "left"), cells.norm, "label").groupBy("label").agg(F.collect_list(F.struct("cell", "reach")).alias("need"))
    more = materialize(_served(placed.join(small_side(materialize(need)), "label"), cells))
    chosen = materialize(_best(first.unionByName(_met(anchors, more, positives, negatives, band)), positives, *me))

    pair = F.struct(F.col("score").alias("pscore"), F.col("key").alias("pkey"), F.col("vec_id").alias("positive_id"), F.lit(None).cast("long").alias("floor"))
    wanted = chosen.where("score >= 0").groupBy(*me).agg(F.collect_list(pair).alias("wanted"))
    asking = materialize(named.join(wanted, me).withColumnsRenamed({"akey": "key", "anchor_id": "vec_id"}))
    first = materialize(_met(asking, near, positives, negatives, band))
    low = -F.floor(F.lit(-band[0]) * F.col("pscore") / 100) - 1  # may be one too low, never too high
    each = [*me, "pkey", "positive_id", "pscore"]
    floor = _best(first, negatives, *each).groupBy(*each).agg(F.when(F.count("*") >= negatives, F.min("score")).alias("found"))
    pairs = asking.select(F.col("key").alias("akey"), F.col("vec_id").alias("anchor_id"), "cell", "far", "square", F.explode("wanted").alias("w")).select(*me, "cell", "far", "square", "w.pscore", "w.pkey", "w.positive_id")
    pairs = pairs.join(floor, each, "left").withColumn("floor", F.greatest(low, "found"))
    pair = F.struct("pscore", "pkey", "positive_id", F.col("found").alias("floor"))
    told = pairs.groupBy(*me).agg(F.collect_list(pair).alias("wanted"))
    asking = materialize(named.join(told, me).withColumnsRenamed({"akey": "key", "anchor_id": "vec_id"}))
    reach = dict(_reach(pairs, cells.norm).collect())  # one line for each pivot at most
    more = materialize(_served(placed, cells, reach))
    found = _best(first.unionByName(_met(asking, more, positives, negatives, band)), negatives, *each)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))
