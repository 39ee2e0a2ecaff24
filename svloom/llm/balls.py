"""Groups of near copies as balls, so that crowded places aren't compared pair by pair.

Vectors within half of the linking angle of a pivot are all linked with each
other.  They stand as one item, the pivot with a radius and a count: another
item is linked with all of them, or with none, where its angle to the pivot says
so whatever their places in the ball are.  Only where it doesn't are the
members themselves compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_weight, written

#: Pivots of a crowded cell at most; what lies near none of them stays single.
PIVOTS = 8
#: Radians by which an angle must clear a bound before it decides for a whole ball.
MARGIN = 1e-7


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def members_of(crowded: DataFrame, similarity: float, unit: Callable, matrix: Callable) -> DataFrame:
    """(node, ball, angle, n) of the rows (key, node, n, vec) of crowded cells that lie in a ball, which is named by its pivot."""
    most = float(np.arccos(similarity)) / 2 - MARGIN
    slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    drawn = crowded.groupBy("key", slot.alias("slot")).agg(F.min_by(F.struct("node", "vec"), F.xxhash64("node", F.lit(1))).alias("p"), F.count("*").alias("rows"))
    pivots = drawn.groupBy("key").agg(F.collect_list("p.node").alias("pivots"), F.flatten(F.collect_list("p.vec")).alias("places"), F.sum("rows").alias("weight"))
    beside = joined_by_weight(crowded, pivots, "key", "weight").select("node", "n", "vec", "pivots", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            node, n, vec, pivots, places = batch.columns
            keys = pivots.to_pylist()
            sizes = np.asarray(vec.value_lengths())
            groups: dict[tuple, list[int]] = {}
            for k, (p, size) in enumerate(zip(keys, sizes.tolist(), strict=True)):
                groups.setdefault((size, *p), []).append(k)
            for (size, *p), rows in groups.items():
                at = pa.array(rows)
                own = unit(matrix(vec.take(at)))
                far = angles(own @ unit(np.asarray(places[rows[0]].values.to_numpy(zero_copy_only=False), float).reshape(-1, size)).T)
                best = far.argmin(1)
                angle = far[np.arange(len(rows)), best]
                inside = np.flatnonzero(angle <= most)
                found.append((node.take(at).to_numpy()[inside], np.array(p)[best[inside]], angle[inside], n.take(at).to_numpy()[inside]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["node", "ball", "angle", "n"])

    return beside.mapInArrow(run, "node long, ball long, angle double, n long")


def balls_of(members: DataFrame) -> DataFrame:
    """(ball, m, rho, rows): how many vectors, the radius and how many classes are in each ball."""
    return members.groupBy("ball").agg(F.sum("n").alias("m"), F.max("angle").alias("rho"), F.count("*").alias("rows")).where("rows > 1")


def judged(linked: np.ndarray, cosines: np.ndarray, rx: np.ndarray, ry: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, open): pairs of items that are linked whole, and those that their angle doesn't decide."""
    reach = rx[:, None] + ry[None, :]
    if not reach.any():
        return linked, np.zeros_like(linked)
    angle, most = angles(cosines), float(np.arccos(similarity))
    wide = reach > 0
    sure = angle + reach <= most - MARGIN
    apart = angle - reach > most + MARGIN
    return np.where(wide, sure, linked), wide & ~sure & ~apart


def opened(pairs: DataFrame, members: DataFrame, tile: int) -> DataFrame:
    """(size, cell, tile, visits, node, n, vec) for pairs of items (x, y) that only their members decide: those of the larger item wait in tiles, the other's visit all of them.

    members: item, node, n, vec of every class that belongs to an item of a pair.
    """
    size = members.groupBy("item").agg(F.count("*").alias("rows"))
    sized = pairs.join(size.select(F.col("item").alias("x"), F.col("rows").alias("x_rows")), "x").join(size.select(F.col("item").alias("y"), F.col("rows").alias("y_rows")), "y")
    first = F.col("x_rows") >= F.col("y_rows")
    held = written(sized.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("held"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("item"), F.ceil(F.greatest("x_rows", "y_rows") / tile).alias("tiles")), "open-pairs")
    place = [F.size("vec").cast("long").alias("size"), F.col("held").alias("cell")]
    waiting = joined_by_weight(members, held.groupBy(F.col("held").alias("item")).agg(F.max("tiles").alias("tiles"), F.first("held").alias("held")).join(size.withColumnRenamed("rows", "weight"), "item"), "item", "weight")
    waiting = waiting.select(*place, F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"), F.lit(0).cast("long").alias("visits"), "node", "n", "vec")
    visiting = members.join(held, "item").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    visiting = visiting.select(*place, "tile", F.lit(1).cast("long").alias("visits"), "node", "n", "vec")
    return waiting.unionByName(visiting)
