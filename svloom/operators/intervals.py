"""Interval operators: islands, merging, range joins, splitting, subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Width of the bins that a range join equates on.
BIN = 10_000
#: Intervals over more bins than this are joined on levels of wider bins.
LEVEL_FACTOR = 16
LEVELS = 5
#: Levels of bins of joins on two places.
PLACE_LEVELS = 4
#: Width of the spans that islands are numbered in.
ISLAND_SPAN = 1_000_000


def _with_spans(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """Rows joined with the table of their spans, on the group (which may be null) and the span."""
    keys = [*by, "__span"]
    z = y.select(*[F.col(k).alias(f"__{k}_k") for k in keys], *[c for c in y.columns if c not in keys])
    cond = F.col("__span") == F.col("____span_k")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}_k"))
    return x.join(z, cond).drop(*[f"__{k}_k" for k in keys])


def running_sums(df: DataFrame, by: list[str], at: str, sums: list[str], order: list[str] = (), after: str | None = None, span: int = ISLAND_SPAN) -> DataFrame:
    """``sums`` as running sums along ``at`` (then ``order``) within each group, each row's own value included.

    after: a new column with the next greater or equal place of the group, null for its last row.
    Rows are windowed within spans of ``span`` places; a table of one row per
    span carries the sums, and the first place of the span behind, over.
    """
    spread = stored(df.withColumn("__span", F.floor(F.col(at) / span)), "spans")
    over = Window.partitionBy(*by).orderBy("__span")
    totals = spread.groupBy(*by, "__span").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums], F.min(at).alias("__first"))
    past = [F.coalesce(F.sum(f"__t_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__p_{c}") for c in sums]
    carried = totals.select(*by, "__span", *past, F.lead("__first").over(over).alias("__behind"))
    inner = Window.partitionBy(*by, "__span").orderBy(at, *order)
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    own = spread.withColumns({f"__r_{c}": F.sum(c).over(running) for c in sums} | ({after: F.lead(at).over(inner)} if after else {}))
    out = _with_spans(own, carried, by).withColumns({c: F.col(f"__r_{c}") + F.col(f"__p_{c}") for c in sums})
    if after:
        out = out.withColumn(after, F.coalesce(after, "__behind"))
    return out.drop("__span", "__behind", *[f"__{k}_{c}" for c in sums for k in "rp"])


def overlap_counts(intervals: DataFrame, asked: DataFrame, by: list[str], bounds: tuple[str, str], keys: list[str], asked_bounds: tuple[str, str], name: str = "n") -> DataFrame:
    """(keys, name): for each asked interval how many others it overlaps, without making a pair.

    That is the starts before its end, less the ends at its start or before:
    two ranks in one order of all places.  Empty intervals overlap nothing.
    """
    (s, e), (a, b) = bounds, asked_bounds
    full, wanted = intervals.where(F.col(s) < F.col(e)), asked.where(F.col(a) < F.col(b))
    no = [F.lit(None).cast(asked.schema[k].dataType).alias(k) for k in keys]

    def rows(df: DataFrame, at: str, first: int, starts: int, ends: int, sign: int, ids: list) -> DataFrame:
        return df.select(*by, *ids, F.col(at).alias("__at"), F.lit(first).alias("__first"), F.lit(starts).cast("long").alias("__s"), F.lit(ends).cast("long").alias("__e"), F.lit(sign).alias("__sign"))

    # at one place: ends, then what asks for starts before it, then starts and what asks for ends up to it
    places = rows(full, e, 0, 0, 1, 0, no).unionByName(rows(full, s, 1, 1, 0, 0, no))
    places = places.unionByName(rows(wanted, b, 0, 0, 0, 1, keys)).unionByName(rows(wanted, a, 1, 0, 0, -1, keys))
    ranked = running_sums(places, by, "__at", ["__s", "__e"], ["__first"]).where("__sign != 0")
    n = F.sum(F.when(F.col("__sign") == 1, F.col("__s")).otherwise(-F.col("__e")))
    return ranked.groupBy(*keys).agg(n.alias(name))


def with_islands(
    df: DataFrame,
    by: list[str],
    start: str,
    end: str,
    gap: int = 0,
    island: str = "island",
    touching: bool = True,
    order: list[str] = (),
    span: int | None = ISLAND_SPAN,
) -> DataFrame:
    """Numbers the transitively connected runs of intervals within each ``by`` group, from 1.

    A run ends where the next start lies beyond the furthest end so far plus
    ``gap`` (at it, if ``touching`` is False).

    A group is not one task: rows are windowed within spans of ``span`` of their
    start, and a table of one row per span carries the furthest end and the
    number of runs over from one span to the next.  With ``span`` None groups
    are windowed whole, which suits groups that are blocks already.
    """
    if span is None:
        whole = Window.partitionBy(*by).orderBy(start, *order, end)
        limit = F.max(end).over(whole.rowsBetween(Window.unboundedPreceding, -1)) + gap
        new = F.when(limit.isNull() | (limit < F.col(start) if touching else limit <= F.col(start)), 1).otherwise(0)
        return df.withColumn("__new", new).withColumn(island, F.sum("__new").over(whole.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    df = df.withColumn("__span", F.floor(F.col(start) / span))
    inner = Window.partitionBy(*by, "__span").orderBy(start, *order, end)
    over = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)

    far = df.groupBy(*by, "__span").agg(F.max(end).alias("__top")).withColumn("__far", F.max("__top").over(over)).drop("__top")
    marked = _with_spans(df, far, by)
    before = F.greatest(F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    limit = before + gap
    new = F.when(before.isNull() | (limit < F.col(start) if touching else limit <= F.col(start)), 1).otherwise(0)
    marked = marked.withColumn("__new", new)
    # stored, since the table of spans and the result both read it: the input isn't planned and shuffled again for each
    marked = stored(marked.withColumn("__nth", F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0))), "islands")
    runs = marked.groupBy(*by, "__span").agg(F.sum("__new").alias("__runs"))
    runs = runs.withColumn("__past", F.coalesce(F.sum("__runs").over(over), F.lit(0))).drop("__runs")
    out = _with_spans(marked, runs, by).withColumn(island, F.col("__nth") + F.col("__past"))
    return out.drop("__span", "__far", "__new", "__nth", "__past")


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: int = 0, strict: bool = False) -> DataFrame:
    """One row per connected run: the group, start, end and n (intervals merged).  strict: mere touching doesn't connect."""
    marked = with_islands(df, by, start, end, gap, "__island", touching=not strict)
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def extend(regions: DataFrame, pad: int, by: list[str] = ("chrom",), start: str = "start", end: str = "end") -> DataFrame:
    """Regions widened on either side, not below 0, and merged again."""
    wide = regions.withColumns({start: F.greatest(F.col(start) - pad, F.lit(0)), end: F.col(end) + pad})
    return merge_intervals(wide, list(by), start, end)


def _levels(start: Column, end: Column, width: int) -> Column:
    """The finest level at which the interval spans at most ``LEVEL_FACTOR`` bins."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when((end - start) <= width * LEVEL_FACTOR ** (k + 1), k).otherwise(out)
    return out


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    how: str = "inner",
    width: int = BIN,
    on: Column | None = None,
    sparse: bool = False,
) -> DataFrame:
    """Pairs whose half-open intervals overlap, as an equi-join on bins with a residual test.

    The right side is filed on the level of bins that suits each interval's
    length, in at most ``LEVEL_FACTOR`` + 1 bins; the left side probes its bins
    on each level.  So a giant interval on the right costs a few rows, not one
    for each bin it covers, and a pair is found in its first common bin only.
    sparse: levels that the right side has nothing on aren't probed; it is read
    at once to find them, so it should be a stored table.
    """
    ls, le = F.col(left_bounds[0]), F.col(left_bounds[1])
    rs, re = F.col(right_bounds[0]), F.col(right_bounds[1])

    def bins(s: Column, e: Column, level: Column) -> Column:
        w = F.lit(width) * F.pow(F.lit(LEVEL_FACTOR), level).cast("long")
        return F.sequence(F.floor(s / w), F.floor(F.greatest(e - 1, s) / w))

    filed = right.withColumn("__level", _levels(rs, re, width)).withColumn("__bin", F.explode(bins(rs, re, F.col("__level"))))
    used = [r[0] for r in right.select(_levels(rs, re, width)).distinct().collect()] or [0] if sparse else range(LEVELS)
    probe = left.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in used])))
    probe = probe.withColumn("__bin", F.explode(bins(ls, le, F.col("__level"))))
    w = F.lit(width) * F.pow(F.lit(LEVEL_FACTOR), F.col("l.__level")).cast("long")
    names = [c for c in right.columns if c not in keys]
    cond = None
    for k in [*keys, "__level", "__bin"]:
        c = F.col(f"l.{k}") == F.col(f"r.{k}")
        cond = c if cond is None else cond & c
    a, b = F.col(f"l.{left_bounds[0]}"), F.col(f"l.{left_bounds[1]}")
    c, d = F.col(f"r.{right_bounds[0]}"), F.col(f"r.{right_bounds[1]}")
    cond = cond & (F.greatest(a, c) < F.least(b, d)) & (F.floor(F.greatest(a, c) / w) == F.col("l.__bin"))
    if on is not None:
        cond = cond & on
    joined = probe.alias("l").join(filed.alias("r"), cond, "inner")
    pairs = joined.select(*[F.col(f"l.{x}") for x in left.columns], *[F.col(f"r.{x}") for x in names])
    if how == "inner":
        return pairs
    hits = joined.select(*[F.col(f"l.{x}") for x in left.columns]).distinct()
    same = [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in left.columns]
    test = same[0]
    for t in same[1:]:
        test = test & t
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"unknown join: {how}")
    return left.alias("x").join(hits.alias("y"), test, how)


def two_place_join(left: DataFrame, right: DataFrame, keys: list[str], left_places: list[tuple[str, str]], right_places: list[tuple[str, str]], width: int = BIN, sparse: bool = False) -> DataFrame:
    """Pairs with equal ``keys`` of which both the first and the second interval overlap, as an equi-join on bins of both places.

    A row is filed in the bins of both its intervals on the level that suits the
    longer one, and on all wider levels; a pair meets on the wider one of its
    two levels, in its first common bin of either place.  So rows that share
    one place alone, such as the breakends around a busy spot, don't meet.
    sparse: rows aren't filed on levels that are no row's own; both sides are
    read at once to find them, so they should be stored tables.
    """

    def level(bounds: list[tuple[str, str]]) -> Column:
        longest = F.greatest(*[F.col(b) - F.col(a) for a, b in bounds])
        out = F.lit(PLACE_LEVELS - 1)
        for k in reversed(range(PLACE_LEVELS - 1)):
            out = F.when(longest <= width * LEVEL_FACTOR**k, k).otherwise(out)
        return out

    used = list(range(PLACE_LEVELS))
    if sparse:
        owned = left.select(level(left_places).alias("k")).union(right.select(level(right_places).alias("k"))).distinct()
        used = sorted(r.k for r in owned.collect()) or [0]

    def filed(df: DataFrame, bounds: list[tuple[str, str]]) -> DataFrame:
        out = df.withColumn("__own", level(bounds)).withColumn("__level", F.explode(F.array(*map(F.lit, used)))).where("__level >= __own")
        w = F.lit(width) * F.pow(F.lit(LEVEL_FACTOR), F.col("__level")).cast("long")
        for k, (a, b) in enumerate(bounds):
            out = out.withColumn(f"__bin{k}", F.explode(F.sequence(F.floor(F.col(a) / w), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / w))))
        return out

    w = F.lit(width) * F.pow(F.lit(LEVEL_FACTOR), F.col("l.__level")).cast("long")
    cond = F.col("l.__level") == F.greatest("l.__own", "r.__own")
    for k in [*keys, "__level", *[f"__bin{k}" for k in range(len(left_places))]]:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    for k, ((a, b), (c, d)) in enumerate(zip(left_places, right_places, strict=True)):
        first = F.greatest(f"l.{a}", f"r.{c}")
        cond = cond & (first < F.least(f"l.{b}", f"r.{d}")) & (F.floor(first / w) == F.col(f"l.__bin{k}"))
    joined = filed(left, left_places).alias("l").join(filed(right, right_places).alias("r"), cond)
    return joined.select(*[F.col(f"l.{x}") for x in left.columns], *[F.col(f"r.{x}") for x in right.columns if x not in keys])


def count_within(rows: DataFrame, regions: DataFrame, by: list[str] = ("chrom",), end_within: Column | None = None, name: str = "count") -> DataFrame:
    """Each region with the number of rows that lie within it; regions without rows count 0.

    rows need start and end, regions start, end and a unique ``region_id``.
    """
    from ..functions.intervals import within

    r = regions.select(*by, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "region_id")
    ok = F.lit(True) if end_within is None else end_within
    wide = rows.withColumns({"__s": F.col("start"), "__e": F.greatest(F.col("end"), F.col("start") + 1), "__inside": ok})
    r = r.withColumns({"__rs": F.col("r_start") - 1, "__re": F.col("r_end") + 1})
    pairs = range_join(wide, r, list(by), ("__s", "__e"), ("__rs", "__re"))
    inside = pairs.where(within(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), F.col("__inside")))
    counts = inside.groupBy("region_id").agg(F.count("*").alias(name))
    return regions.join(counts, "region_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def touching_regions(a: DataFrame, b: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """The regions of ``a`` that touch or overlap one of ``b``."""
    bb = merge_intervals(b.select(*by, F.col("start"), F.col("end")), list(by)).select(*by, F.col("start").alias("__bs"), (F.col("end") + 1).alias("__be"))
    aa = a.withColumn("__ae", F.col("end") + 1)
    return range_join(aa, bb, list(by), ("start", "__ae"), ("__bs", "__be"), "left_semi").drop("__ae")


def boundaries(df: DataFrame, by: list[str], values: list[str], start: str = "start", end: str = "end", extra: list[str] = ()) -> DataFrame:
    """(by, extra, at, values): what starts less what ends at each place that bounds an interval."""
    opened = df.select(*by, *extra, F.col(start).alias("at"), *values)
    closed = df.select(*by, *extra, F.col(end).alias("at"), *[(-F.col(c)).alias(c) for c in values])
    return opened.unionByName(closed).groupBy(*by, *extra, "at").agg(*[F.sum(c).alias(c) for c in values])


def covered_segments(df: DataFrame, by: list[str], values: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, seg_start, seg_end, n, values): the disjoint segments between all boundaries of a group, with the number and the sums of the intervals that cover each; uncovered ones too."""
    marks = boundaries(df.where(F.col(start) < F.col(end)).withColumn("n", F.lit(1).cast("long")), by, ["n", *values], start, end)
    summed = running_sums(marks, by, "at", ["n", *values], after="seg_end")
    return summed.where(F.col("seg_end").isNotNull()).withColumnRenamed("at", "seg_start")


def subtract(df: DataFrame, masks: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """What is left of intervals (group, start, end) outside the masks, as disjoint pieces of the merged input."""
    by = list(by)
    whole = df.select(*by, "start", "end").withColumns({"__whole": F.lit(1).cast("long"), "__mask": F.lit(0).cast("long")})
    cut = masks.select(*by, "start", "end").withColumns({"__whole": F.lit(0).cast("long"), "__mask": F.lit(1).cast("long")})
    pieces = covered_segments(whole.unionByName(cut), by, ["__whole", "__mask"])
    left = pieces.where((F.col("__whole") > 0) & (F.col("__mask") == 0)).select(*by, F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    return merge_intervals(left, by).select(*by, "start", "end")


def tiles(contigs: DataFrame, size: int, step: int | None = None, length: str = "length") -> DataFrame:
    """Windows of ``size`` every ``step`` along each contig, the last cut at its end."""
    step = step or size
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(length) - 1, F.lit(0)).cast("long"), F.lit(step).cast("long")))
    return contigs.withColumn("start", starts).withColumn("end", F.least(F.col("start") + size, F.col(length)))


def region_tiles(regions: DataFrame, size: int = 10_000_000) -> DataFrame:
    """Each region cut into pieces of ``size`` from its start on, the last one as long as what is left; empty regions stay one piece."""
    starts = F.sequence(F.col("start"), F.greatest(F.col("end") - 1, F.col("start")), F.lit(size).cast("long"))
    return regions.withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size, F.col("end")))
