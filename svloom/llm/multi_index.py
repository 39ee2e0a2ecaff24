"""Near-duplicate vectors by an inverted multi-index.

A codebook for each half of the vectors makes a grid of cells.  Every vector
lies in the cell of its nearest codes; on the way over the grid from the
nearest cell on, it visits all cells up to a cost at which partners just within
the limit are found with the target recall.  What meets in a cell is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .balls import balls_of, judged, members_of, opened
from .common import joined_by_weight, tune, written
from .graph import components

#: Vectors that codebooks are learned from at most, and rounds of learning.
SAMPLE, ROUNDS = 16_384, 12
#: Vectors of a cell on average, and codes of a half at most.
CELL_ROWS, MOST_CODES = 512, 256
#: Share of the pairs at just the least similarity whose cells are visited; nearer pairs are found more often.
RECALL = 0.98
#: Vectors of which a cell's tile consists; cells of more have several.
TILE = 2048
#: Visits sent on in one Arrow batch.
SENT = 20_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; they are scaled before, so no square overflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each code."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def learned_codes(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Means of ``k`` groups; a code that loses all its rows stays where it is."""
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = distances(x, codes).argmin(1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(codes)
        np.add.at(total, own, x)
        codes[size > 0] = total[size > 0] / size[size > 0, None]
    return codes


@dataclass
class Grid:
    """Codebooks of both halves, the cost up to which cells are visited, and the number of tiles of crowded cells by (length, cell)."""

    codes: tuple[np.ndarray, np.ndarray]
    width: int
    limit: float = np.inf
    tiles: dict[tuple[int, int], int] | None = None

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, filled up with zeros, as distances to the codes of each half."""
        if x.shape[1] < self.width:
            x = np.concatenate([x, np.zeros((len(x), self.width - x.shape[1]))], axis=1)
        at = self.width // 2
        return distances(x[:, :at], self.codes[0]), distances(x[:, at:], self.codes[1])

    def cells(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.argmin(1) * len(self.codes[1]) + two.argmin(1)

    def visits(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within the limit of the row's nearest one.

        Both halves' codes are taken in order of distance; with the r-th code of
        the first half go as many of the second as the rest of the limit
        allows, which are fewer for each further code.
        """
        k = len(self.codes[1])
        o1, o2 = one.argsort(1, kind="stable"), two.argsort(1, kind="stable")
        s1, s2 = np.take_along_axis(one, o1, 1), np.take_along_axis(two, o2, 1)
        left = self.limit + s1[:, :1] + s2[:, :1]
        rows, cells = [], []
        for r in range(s1.shape[1]):
            count = (s2 + s1[:, r : r + 1] <= left).sum(1)
            if not count.any():
                break
            row = np.repeat(np.arange(len(one)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            rows.append(row)
            cells.append(o1[row, r] * k + o2[row, nth])
        return np.concatenate(rows), np.concatenate(cells)


def learn(sample: np.ndarray, n: int, similarity: float, recall: float = RECALL, cell_rows: int = CELL_ROWS) -> Grid:
    """A grid for ``n`` vectors from a sample of unit vectors."""
    rng = np.random.default_rng(42)
    k = int(min(max(round((n / cell_rows) ** 0.5), 1), MOST_CODES, len(sample)))
    at = sample.shape[1] // 2
    grid = Grid((learned_codes(sample[:, :at], k, rng), learned_codes(sample[:, at:], k, rng)), sample.shape[1])
    grid.limit = limit_of(grid, sample, similarity, recall)
    return grid


def limit_of(grid: Grid, sample: np.ndarray, similarity: float, recall: float) -> float:
    """The cost up to which a vector visits cells, so that a partner at just this similarity, in a random direction, lies in one of them with the target recall."""
    k, rng = len(grid.codes[1]), np.random.default_rng(43)
    if k == 1:
        return np.inf
    x = sample[rng.permutation(len(sample))[:4096]]
    aside = rng.standard_normal(x.shape) * (x != 0)
    aside -= (aside * x).sum(1, keepdims=True) * x
    size = np.sqrt((aside * aside).sum(1, keepdims=True))
    y = similarity * x + (1 - similarity**2) ** 0.5 * np.divide(aside, size, out=np.zeros_like(x), where=size > 0)
    one, two = grid.halves(x)
    other = grid.cells(*grid.halves(y))
    rows = np.arange(len(x))
    cost = one[rows, other // k] + two[rows, other % k] - one.min(1) - two.min(1)
    return float(np.quantile(cost, recall))


def forward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which one of two different numbers visits the other: each number visits about half of the others."""
    return (a < b) == ((a + b) % 2 == 0)


def roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links the least column that it reaches; the number of columns where it has no link."""
    n = linked.shape[1]
    col = np.where(linked.any(0), np.arange(n), n)
    while True:
        row = np.where(linked, col, n).min(1, initial=n)
        new = np.minimum(col, np.where(linked, row[:, None], n).min(0, initial=n))
        if (new == col).all():
            return row, col
        col = new


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _usable(vec: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(vec, node, n, least) of usable vectors (row, id, vec): exact copies as one, with the least row, the number and the least id."""
    return vectors.where(_usable(F.col("vec"))).groupBy("vec").agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("id").alias("least"))


def met(items: DataFrame, grid: Grid) -> DataFrame:
    """(size, cell, tile, visits, node, n, vec, rho): each item (vec, node, n, rho) in its own tile, and as a visitor in the tiles that it visits.

    Of two cells, and of two tiles of a cell, one visits the other, so every
    pair meets in one place at most.
    """
    kind = items.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(0)
            sizes = np.asarray(vec.value_lengths())
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                nodes = own.column(1).to_numpy()
                one, two = grid.halves(unit(matrix(own.column(0))))
                cells = grid.cells(one, two)
                tiles = np.array([grid.tiles.get((int(size), c), 1) for c in cells.tolist()])
                tile = _spread(nodes, tiles)
                rows, seen = grid.visits(one, two)
                away = seen != cells[rows]
                rows, seen = rows[away], seen[away]
                goes = forward(cells[rows], seen)
                rows, seen = rows[goes], seen[goes]
                times = np.array([grid.tiles.get((int(size), c), 1) for c in seen.tolist()], np.int64)
                rows, seen = np.repeat(rows, times), np.repeat(seen, times)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                # the other tiles of the own cell
                home = np.repeat(np.arange(len(nodes)), tiles)
                there = np.arange(len(home)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                goes = (there != tile[home]) & forward(tile[home], there)
                home, there = home[goes], there[goes]
                take = np.concatenate([np.arange(len(nodes)), rows, home])
                cell = np.concatenate([cells, seen, cells[home]])
                at = np.concatenate([tile, nth, there])
                visits = np.concatenate([np.zeros(len(nodes), np.int64), np.ones(len(rows) + len(home), np.int64)])
                for lo in range(0, len(take), SENT):
                    part = slice(lo, lo + SENT)
                    got = own.take(pa.array(take[part]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(got), size, np.int64)), pa.array(cell[part]), pa.array(at[part]), pa.array(visits[part]), got.column(1), got.column(2), got.column(0), got.column(3)],
                        ["size", "cell", "tile", "visits", "node", "n", "vec", "rho"],
                    )

    return items.select("vec", "node", "n", "rho").mapInArrow(run, f"size long, cell long, tile long, visits long, node long, n long, vec {kind}, rho double")


def _spread(nodes: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    """A tile for each node, by a mix of its bits."""
    x = nodes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(33))) % tiles.astype(np.uint64)).astype(np.int64)


def verified(meetings: DataFrame, similarity: float, among: bool = True) -> DataFrame:
    """(node, root, links, open): for each item with links in a tile, one that it hangs together with there, and how many vectors it is linked with.

    A task holds one tile's members; visitors pass by.  No row is made for a
    pair, but for those of which one is a ball that the angle doesn't decide:
    node and open are theirs.  among: whether a tile's members are compared with
    each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own = None, [], None

        def links(x, x_nodes, x_n, x_rho, within: bool) -> Iterator[pa.RecordBatch]:
            members, nodes, n, rho = own
            cosines = x @ members.T
            linked, undecided = judged(cosines >= similarity, cosines, x_rho, rho, similarity)
            if within:
                np.fill_diagonal(linked, False)
                undecided = np.triu(undecided, 1)
            rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            found = []
            if len(rows):
                few = linked[np.ix_(rows, cols)]
                row_root, col_root = roots(few)
                found.append((x_nodes[rows], nodes[cols][row_root], few @ n[cols], None))
                if not within:
                    found.append((nodes[cols], nodes[cols][col_root], x_n[rows] @ few, None))
            a, b = np.nonzero(undecided)
            if len(a):
                found.append((x_nodes[a], None, None, nodes[b]))
            for part in found:
                size = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c.astype(np.int64)) for c in part], ["node", "root", "links", "open"])

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal own
            if held:
                vec, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
                own = (unit(vec), *rest)
                held.clear()
                if among:
                    yield from links(*own, True)

        for batch in batches:
            where = np.stack([c.to_numpy() for c in batch.columns[:4]], axis=1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                size, cell, tile, visits = where[lo].tolist()
                if (size, cell, tile) != key:
                    yield from settled()
                    key, own = (size, cell, tile), None
                part = batch.slice(lo, hi - lo)
                data = matrix(part.column(6)), part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(7).to_numpy()
                if not visits:
                    held.append(data)
                    continue
                yield from settled()
                if own is not None:
                    yield from links(unit(data[0]), *data[1:], False)
        yield from settled()

    place = ["size", "cell", "tile"]
    dealt = meetings.repartition(*place).sortWithinPartitions(*place, "visits")
    return dealt.mapInArrow(run, "node long, root long, links long, open long")


def _linked(classes: DataFrame, grid: Grid, sample: np.ndarray, similarity: float, recall: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(node, others) and edges (u, v) of classes: with how many vectors of other classes each is linked, and what hangs together."""
    grid.tiles = _crowded(classes, grid, tile)
    plain = classes.select("vec", "node", "n", F.lit(0.0).alias("rho"))
    inside = None
    if grid.tiles:
        members = written(members_of(written(_in_crowded(classes, grid), "crowded"), similarity, unit, matrix), "members")
        balls = written(balls_of(members), "balls")
        inside = written(joined_by_weight(members, balls.withColumn("weight", F.col("rows")), "ball", "weight").select("node", "ball", "n", "m"), "inside")
        single = plain.join(inside.select("node"), "node", "left_anti").select("vec", "node", "n", "rho")
        stand = balls.join(classes.select("vec", F.col("node").alias("ball")), "ball").select("vec", F.col("ball").alias("node"), F.col("m").alias("n"), "rho")
        plain = written(single.unionByName(stand), "items")
        grid.tiles = _crowded(plain, grid, tile)
        # partners of a ball's members may lie further from its pivot, and those of two balls twice as far
        widest = balls.agg(F.max("rho")).first()[0] or 0.0
        grid.limit = limit_of(grid, sample, float(np.cos(min(np.arccos(similarity) + 2 * widest, np.pi))), recall)
    found = written(verified(met(plain, grid), similarity), "links")
    settled = found.where("open IS NULL")
    links = settled.groupBy("node").agg(F.sum("links").alias("links"))
    edges = settled.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if inside is None:
        return links.withColumnRenamed("links", "others"), edges
    pairs = found.where("open IS NOT NULL").select(F.col("node").alias("x"), F.col("open").alias("y"))
    asked = pairs.select(F.col("x").alias("item")).union(pairs.select("y")).distinct()
    of_balls = inside.select("node", F.col("ball").alias("item")).join(asked, "item", "left_semi")
    of_items = asked.join(inside.select(F.col("ball").alias("item")).distinct(), "item", "left_anti").select(F.col("item").alias("node"), "item")
    parts = written(of_balls.unionByName(of_items).join(classes.select("node", "n", "vec"), "node"), "open-members")
    more = written(verified(opened(pairs, parts, tile).withColumn("rho", F.lit(0.0)), similarity, among=False), "open-links")
    # a ball's members have its links, and each other
    shared = balls.join(links.withColumnRenamed("node", "ball"), "ball", "left").select("ball", F.coalesce("links", F.lit(0)).alias("links"), F.col("rows").alias("weight"))
    within = joined_by_weight(inside, shared, "ball", "weight").select("node", (F.col("m") - F.col("n") + F.col("links")).alias("links"))
    others = links.join(balls.select(F.col("ball").alias("node")), "node", "left_anti").unionByName(within).unionByName(more.select("node", "links"))
    edges = edges.unionByName(more.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    edges = edges.unionByName(inside.where("node != ball").select(F.col("node").alias("u"), F.col("ball").alias("v")))
    return others.groupBy("node").agg(F.sum("links").alias("others")), edges


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = 0.9, recall: float = RECALL, cell_rows: int = CELL_ROWS, tile: int = TILE) -> DataFrame:
    """``vectors`` with n_links, component_id and kept in place of the vector.

    Vectors of one length link at a cosine of ``similarity`` or more, in double
    precision; vectors that are null, empty, zero or hold null or non-finite
    components link with nothing.  n_links counts the linked rows other than
    the row itself, component_id is the smallest id that links reach, kept says
    whether that is the row's own.

    Codebooks come from at most SAMPLE vectors, of the smallest hashes; every
    vector is in the index.  Links below the least similarity are never made;
    ``recall`` is the share of pairs at just that similarity that is found at
    least, and nearer ones are found more often.  Exact copies are one vector
    with a count; near copies in crowded cells, that all link with each other,
    are balls (see ``balls``).  Cells of any size are handled in tiles.

    Repeated rows and ids are vectors of their own, rows with a null id link
    like others and have the smallest id of their component (null if there is
    none); other columns stay, those of the new names are replaced.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    names = [c for c in vectors.columns if c.lower() not in ("n_links", "component_id", "kept") and c != vec_col]
    keep = [f"c{vectors.columns.index(c)}" for c in names]
    own = f"c{vectors.columns.index(id_col)}"
    bare = vectors.toDF(*[f"c{k}" for k in range(len(vectors.columns))])
    bare = bare.select(*keep, F.col(own).alias("id"), F.col(f"c{vectors.columns.index(vec_col)}").alias("vec"), F.monotonically_increasing_id().alias("row"))
    base = written(bare, "vectors")
    classes = written(classes_of(base), "classes")
    n = classes.count()
    if n > 1:
        width = classes.agg(F.max(F.size("vec"))).first()[0]
        drawn = classes.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
        sample = np.zeros((len(drawn), width))
        sizes = np.asarray(drawn.value_lengths())
        for size in np.unique(sizes):
            sample[sizes == size, :size] = unit(matrix(drawn.filter(pa.array(sizes == size))))
        grid = learn(sample, n, similarity, recall, cell_rows)
        others, edges = _linked(classes, grid, sample, similarity, recall, tile)
        of = components(edges).withColumnRenamed("root", "top")
        known = classes.join(others, "node", "left").join(of, "node", "left")
        known = written(known.withColumns({"others": F.coalesce("others", F.lit(0).cast("long")), "top": F.coalesce("top", "node")}), "known")
        tops = known.groupBy("top").agg(F.min("least").alias("component"), F.count("*").alias("weight"))
        known = written(joined_by_weight(known, tops, "top", "weight"), "known")
    else:
        known = classes.withColumns({"others": F.lit(0).cast("long"), "component": F.col("least")})
    result = known.select("vec", F.col("n").alias("weight"), (F.col("n") - 1 + F.col("others")).alias("n_links"), F.col("component").alias("component_id"))
    usable = base.where(_usable(F.col("vec")))
    some = joined_by_weight(usable, result, "vec", "weight")
    rest = base.where(~_usable(F.col("vec"))).withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("id")})
    both = some.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return both.select(*keep, "n_links", "component_id", "kept").toDF(*names, "n_links", "component_id", "kept")


def _crowded(classes: DataFrame, grid: Grid, tile: int) -> dict[tuple[int, int], int]:
    """Numbers of tiles of the cells with more than ``tile`` classes: at most one in ``tile`` classes, and no more than the grid has cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for size in np.unique(sizes):
                cells = grid.cells(*grid.halves(unit(matrix(batch.column(0).filter(pa.array(sizes == size))))))
                cell, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), size, np.int64)), pa.array(cell), pa.array(n)], ["size", "cell", "n"])

    counts = classes.select("vec").mapInArrow(run, "size long, cell long, n long").groupBy("size", "cell").agg(F.sum("n").alias("n"))
    return {(r["size"], r["cell"]): -(-r["n"] // tile) for r in counts.where(F.col("n") > tile).collect()}


def _in_crowded(classes: DataFrame, grid: Grid) -> DataFrame:
    """(key, node, n, vec) of the classes in crowded cells; key names the cell and the vectors' length."""
    kind, width = classes.schema["vec"].dataType.simpleString(), len(grid.codes[0]) * len(grid.codes[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                cells = grid.cells(*grid.halves(unit(matrix(own.column(0)))))
                inside = np.array([(int(size), c) in grid.tiles for c in cells.tolist()])
                got = own.filter(pa.array(inside))
                yield pa.RecordBatch.from_arrays([pa.array(size * width + cells[inside]), got.column(1), got.column(2), got.column(0)], ["key", "node", "n", "vec"])

    return classes.select("vec", "node", "n").mapInArrow(run, f"key long, node long, n long, vec {kind}")
