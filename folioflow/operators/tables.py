"""Tables as rows: header grids, containment, runs, rectangles; reconcile.py has whole pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least token overlap of a match and of what is attached to it, row ratio, gaps.
MATCH, ATTACH, ROW_RATIO, GAP, EDGE, FIT = 0.60, 0.25, (0.4, 3.0), 40.0, 5.0, 1.5
SEPARATOR = " - "
#: Tokens that are broadcast at most.
BROADCAST_TOKENS = 200_000


def flatten_headers(cells: DataFrame) -> DataFrame:
    """Return (table_id, c, name): one header row for the header cells of tables.

    ``cells`` is (table_id, r, cell_seq, rowspan, colspan, text) of header rows;
    spans that are no number count as 1.  A cell takes the first free column, and
    a later cell overwrites what it covers.  A column's name joins its distinct
    texts from the top, equal neighbours once.
    """
    span = lambda c: F.greatest(F.coalesce(F.expr(f"try_cast({c} AS int)"), F.lit(1)), F.lit(1))
    own = cells.select("table_id", F.struct("r", "cell_seq", span("rowspan").alias("h"), span("colspan").alias("w"), F.trim("text").alias("t")).alias("x"))
    rows = own.groupBy("table_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # The fold keeps the covered places and the column after the last cell of the row.
    covered = "flatten(transform(sequence(0, x.h - 1), i -> transform(sequence(0, x.w - 1), j -> named_struct('r', x.r + i, 'c', col + j, 'n', bigint(x.r) * 4294967296 + x.cell_seq, 't', x.t))))"
    free = "element_at(filter(sequence(if(s.row = x.r, s.next, 0), if(s.row = x.r, s.next, 0) + size(s.grid)), k -> NOT exists(s.grid, g -> g.r = x.r AND g.c = k)), 1)"
    step = f"(s, x) -> element_at(transform(array({free}), col -> named_struct('row', x.r, 'next', col + x.w, 'grid', concat(s.grid, {covered}))), 1)"
    start = "named_struct('row', -1, 'next', 0, 'grid', cast(array() AS array<struct<r:int,c:int,n:bigint,t:string>>))"
    grid = rows.select("table_id", F.expr(f"inline(aggregate(xs, {start}, {step}, s -> s.grid))"))
    top = grid.groupBy("table_id", "r", "c").agg(F.max_by("t", "n").alias("t"))
    texts = top.groupBy("table_id", "c").agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("ts"))
    once = "aggregate(filter(transform(ts, x -> x.t), t -> t <> ''), cast(array() AS array<string>), (a, t) -> if(size(a) > 0 AND element_at(a, -1) = t, a, concat(a, array(t))))"
    return texts.select("table_id", "c", F.expr(f"array_join({once}, '{SEPARATOR}')").alias("name"))


def best_container(parts: DataFrame, wholes: DataFrame, least: float = MATCH) -> DataFrame:
    """Return (part_id, whole_id, overlap): for each token set the one that holds most of it.

    ``parts`` is (part_id, tokens) and ``wholes`` (whole_id, tokens), of distinct
    tokens; ties go to the smaller whole_id, empty sets match nothing.  Tokens are
    joined by value and counted, so no pair without a common token is made; where
    the parts are few, by count, they are broadcast, and other tokens of the wholes
    go no further.
    """
    p = parts.select("part_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    w = wholes.select("whole_id", F.explode("tokens").alias("token"))
    few = p.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    common = w.join(F.broadcast(p) if few else p, "token").groupBy("part_id", "whole_id", "n").agg(F.count("*").alias("m"))
    scored = common.withColumn("overlap", F.col("m") / F.col("n"))
    order = Window.partitionBy("part_id").orderBy(F.col("overlap").desc(), "whole_id")
    return scored.withColumn("k", F.row_number().over(order)).where((F.col("k") == 1) & (F.col("overlap") >= least)).select("part_id", "whole_id", "overlap")


def adjacency_groups(items: DataFrame, keys: list[str], start: str, end: str, order: list[str], gap: float) -> DataFrame:
    """Add ``run``: the number of the run an item is in; a larger gap starts a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    jump = F.coalesce((F.col(start) - F.lag(end).over(w) > gap).cast("int"), F.lit(0))
    marked = items.withColumn("_jump", jump)
    return marked.withColumn("run", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def intersects(a: str, b: str) -> Column:
    """Whether two rectangles, given by column prefixes, overlap in an area."""
    c = F.col
    return (c(f"{a}x0") < c(f"{b}x1")) & (c(f"{b}x0") < c(f"{a}x1")) & (c(f"{a}y0") < c(f"{b}y1")) & (c(f"{b}y0") < c(f"{a}y1"))


def rect_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Return the pairs of rectangles (l_*, r_*) that overlap, among those with equal keys."""
    return left.join(right, keys).where(intersects("l_", "r_"))


def _spans(first: np.ndarray, r: np.ndarray, c: np.ndarray, x0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return (place, rowspan, colspan) of the cells of whole tables; places come by table, row and column, ``first`` marks a table's first."""
    t = np.cumsum(first)
    again = (t[1:] == t[:-1]) & (r[1:] == r[:-1]) & (c[1:] == c[:-1])
    place = np.flatnonzero(~np.append(again, False) & ~np.isnan(x0))  # of a repeated place the last one counts
    n = len(place)
    if not n:
        return place, place, place
    t, r, c, x0, x1, y1 = (v[place].astype(np.int64 if v.dtype.kind == "i" else np.float64) for v in (t, r, c, x0, x1, y1))
    fresh = lambda *keys: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    number = lambda start: np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    far = np.iinfo(np.int64).max

    # Rows of cells, and the next cell in each; columns likewise, in an order of their own.
    top = fresh(t, r)
    row, down = number(top), np.lexsort((r, c, t))
    side = fresh(t[down], c[down])
    column = np.empty(n, np.int64)
    column[down] = number(side)
    right, below = np.full(n, far), np.full(n, far)
    right[:-1] = np.where(row[1:] == row[:-1], c[1:], far)
    below[down[:-1]] = np.where(column[down[1:]] == column[down[:-1]], r[down[1:]], far)

    # A column has a rectangle within (low, high) if the least x1 of those from ``low`` on is within.
    lows = np.unique(x0)
    by_low = np.lexsort((x0, column))
    keys = column[by_low] * (len(lows) + 1) + np.searchsorted(lows, x0[by_low])
    ends = np.append(side[1:], n)
    least = np.where(np.isnan(x1), np.inf, x1)[by_low][::-1]
    # Least from the right within each column: ranks that fall from column to column keep them apart.
    values, rank = np.unique(least, return_inverse=True)
    back = column[by_low][::-1] * (len(values) + 1)
    least = values[np.minimum.accumulate(back + rank) - back]
    least = least[::-1]
    w = np.ones(n, np.int64)
    live = np.flatnonzero(right > c + 1)
    while len(live):
        g = np.minimum(column[live] + w[live], len(side) - 1)
        head = down[side[g]]
        ok = (g == column[live] + w[live]) & (t[head] == t[live]) & (c[head] == c[live] + w[live]) & (right[live] > c[live] + w[live])
        at = np.searchsorted(keys, g * (len(lows) + 1) + np.searchsorted(lows, x0[live] - FIT))
        ok &= (at < ends[g]) & (least[np.minimum(at, n - 1)] <= x1[live] + FIT)
        live = live[ok]
        w[live] += 1

    bottom = np.maximum.reduceat(y1, top)
    h = np.ones(n, np.int64)
    live = np.flatnonzero(below > r + 1)
    while len(live):
        g = np.minimum(row[live] + h[live], len(top) - 1)
        head = top[g]
        ok = (g == row[live] + h[live]) & (t[head] == t[live]) & (r[head] == r[live] + h[live]) & (below[live] > r[live] + h[live])
        live = live[ok & (bottom[g] <= y1[live] + FIT)]
        h[live] += 1

    # Cells inside a block of several rows and columns are covered, unless the block's own cell is.
    block = np.flatnonzero((h > 1) & (w > 1))
    own = np.repeat(block, h[block] - 1)
    inner = row[own] + np.arange(len(own)) - np.repeat(np.cumsum(h[block] - 1) - (h[block] - 1), h[block] - 1) + 1
    left = int(c.min())
    width = int(c.max()) - left + 2
    spots = row * width + (c - left)
    start = np.searchsorted(spots, inner * width + (c[own] - left), side="right")
    stop = np.searchsorted(spots, inner * width + np.minimum(c[own] + w[own] - left, width))
    taken = np.zeros(n, bool)
    for i in np.flatnonzero(start < stop).tolist():
        if not taken[own[i]]:
            taken[start[i] : stop[i]] = True
    return place[~taken], h[~taken], w[~taken]


def topology(cells: DataFrame) -> DataFrame:
    """Return (table_id, r, c, rowspan, colspan) of cells from their rectangles.

    ``cells`` is (table_id, r, c, x0, y0, x1, y1), with null rectangles for places
    that another cell covers.  A cell spans the null places to its right whose
    column, where it has a rectangle in some other row, lies within it; it spans
    rows while the next row's bottom is within it.  Of a repeated place the largest
    rectangle counts, in the order of its coordinates.  Tables come sorted, and all
    whole ones of an Arrow batch are worked out at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(table: pa.Table) -> pa.RecordBatch:
            col = lambda name: table.column(name).to_numpy()
            numbers = lambda name: col(name).astype(np.float64)
            place, h, w = _spans(col("nth") == 1, col("r"), col("c"), numbers("x0"), numbers("x1"), numbers("y1"))
            own = table.select(["table_id", "r", "c"]).take(pa.array(place)).combine_chunks()
            columns = [own.column(i).combine_chunks() for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(h, pa.int32()), pa.array(w, pa.int32())], names=["table_id", "r", "c", "rowspan", "colspan"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("nth").to_numpy() == 1)
            if len(starts):
                cut = int(starts[-1])  # what follows belongs to a table that may go on in the next batch
                whole = [b for b in (*held, batch.slice(0, cut)) if b.num_rows]
                if whole:
                    yield spans(pa.Table.from_batches(whole))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield spans(pa.Table.from_batches(held))

    order = Window.partitionBy("table_id").orderBy("r", "c", "x0", "y0", "x1", "y1")
    known = cells.where(F.col("r").isNotNull() & F.col("c").isNotNull()).select(F.col("table_id").cast("long").alias("table_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "x0", "y0", "x1", "y1")
    ranked = known.select("table_id", "r", "c", "x0", "x1", "y1", F.row_number().over(order).alias("nth"))
    return ranked.mapInArrow(run, "table_id long, r int, c int, rowspan int, colspan int")


def header_rows(spans: DataFrame, hint: int = 1) -> DataFrame:
    """Return (table_id, header_rows): ``hint`` rows, more so that no header cell is cut, at most all rows."""
    last = F.max(F.col("r") + F.col("rowspan"))
    head = F.max(F.when(F.col("r") < hint, F.col("r") + F.col("rowspan")))
    return spans.groupBy("table_id").agg(F.least(F.greatest(F.lit(hint), head), last).alias("header_rows"))
