"""Samples by cells: exact integer quotas, smallest random keys in each cell, design weights."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.session import checkpointed

BROADCAST_CELLS = 200_000


def largest_remainder(weights: list[float], total: int, floors: list[int], caps: list[int]) -> list[int]:
    """Integer quotas that add up to ``total`` where floors and caps allow, in proportion to the weights.

    Floors are met first, as far as caps allow; what is left is shared out by weight, categories at
    their cap drop out and the others share again. Equal remainders go to the earlier category.
    """
    n = len(weights)
    quota = [min(f, c) for f, c in zip(floors, caps)]
    want = sum(weights) or 1.0
    open_ = [i for i in range(n) if weights[i] > 0 and quota[i] < caps[i]]
    # floors count towards a category's share: raise the others until the total is reached
    share = [w / want * total for w in weights]
    goal = {i: max(float(quota[i]), min(share[i], caps[i])) for i in range(n)}
    for _ in range(n + 1):
        gap = total - sum(goal.values())
        free = [i for i in open_ if (goal[i] < caps[i] if gap > 0 else goal[i] > quota[i])]
        if abs(gap) < 1e-9 or not free:
            break
        weight = sum(weights[i] for i in free)
        for i in free:
            goal[i] = min(float(caps[i]), max(float(quota[i]), goal[i] + gap * weights[i] / weight))
    out = [math.floor(goal[i] + 1e-9) for i in range(n)]
    rest = sorted(range(n), key=lambda i: (-(goal[i] - out[i]), i))
    left = min(total, round(sum(goal.values()))) - sum(out)
    for i in rest:
        if left <= 0:
            break
        if out[i] < caps[i] and goal[i] > out[i] + 1e-9:
            out[i] += 1
            left -= 1
    return out


def random_key(seed: int, *columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on the row alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)


def smallest_keys(rows: DataFrame, quotas: DataFrame, on: list[str], key: str, seed: int, by: tuple[str, ...] = (), slack: float = 8.0) -> DataFrame:
    """The rows of each cell with the smallest random keys, exactly as many as its quota (all where it has fewer).

    ``rows``: unique ``key`` and the cell columns ``on``, none null. ``quotas``: ``on``, ``by`` (a cell may be
    drawn from several times, for instance by plan; each has keys of its own), quota and cell_rows, the
    exact number of rows of the cell. Which rows are drawn depends on seed and keys only.

    Rows with keys far under the expected threshold are taken as they are, rows far over it left out; only
    the narrow band between is ranked, so no cell is sorted as a whole. The counts of every cell are checked
    afterwards; a cell whose threshold lay outside the band (``slack`` standard deviations) is ranked in full.
    """
    cell = [*by, *on]
    wide = slack * F.sqrt("quota") + 5 * slack
    q = quotas.withColumn("_low", (F.col("quota") - wide) / F.col("cell_rows")).withColumn("_high", (F.col("quota") + wide) / F.col("cell_rows"))
    q = F.broadcast(q) if q.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else q
    keyed = rows.join(q, on).withColumn("_u", random_key(seed, *[F.col(c) for c in by], F.col(key)))
    near = checkpointed(keyed.where(F.col("_u") <= F.col("_high")))
    seen = near.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_u") <= F.col("_low")).alias("_sure"))
    state = q.join(seen, cell, "left").na.fill(0, ["_n", "_sure"])
    missed = checkpointed(state.where((F.col("_n") < F.least("quota", "cell_rows")) | (F.col("_sure") > F.col("quota"))).select(*cell))
    bounds = state.select(*cell, "_sure")
    placed = near.join(F.broadcast(missed), cell, "left_anti").join(F.broadcast(bounds) if q.count() <= BROADCAST_CELLS else bounds, cell)
    group = Window.partitionBy(*cell).orderBy("_u", key)
    sure = placed.where(F.col("_u") <= F.col("_low"))
    band = placed.where(F.col("_u") > F.col("_low")).withColumn("_rank", F.row_number().over(group)).where(F.col("_rank") <= F.col("quota") - F.col("_sure")).drop("_rank")
    out = sure.unionByName(band).select(*keyed.columns)
    if not missed.isEmpty():
        out = out.unionByName(keyed.join(F.broadcast(missed), cell, "left_semi").withColumn("_rank", F.row_number().over(group)).where("_rank <= quota").drop("_rank"))
    return out.drop("_low", "_high", "_u")


def level_quotas(sizes: dict[float, int], n: int, floors: dict[float, int]) -> dict[float, int]:
    """Rows for each severity level: in proportion to size, no fewer than its floor, no more than its size, ``n`` in all (or everything).

    Floors that add up to more than ``n`` are cut in proportion.
    """
    levels = sorted(sizes)
    caps = [sizes[k] for k in levels]
    least = [min(floors.get(k, 0), sizes[k]) for k in levels]
    if sum(least) > n:
        least = largest_remainder(least, n, [0] * len(levels), least)
    return dict(zip(levels, largest_remainder(caps, min(n, sum(caps)), least, caps)))


def stratified_sample(corpus: DataFrame, n: int, seed: int, floors: dict[float, int] | None = None) -> DataFrame:
    """Exactly ``n`` rows (all when there are fewer), one for each doc_id, in its order, with sampling_weight N_h / n_h of their severity level.

    Quotas are exact: first by severity level with its floor, then in a level by year, both by largest
    remainder, so nothing has to be trimmed or topped up. Only counts of (level, year) come to the driver.
    Unknown severity is a level of its own (-1), and so is an unknown year. Of rows with the same doc_id one
    counts (least level, then least year); rows without doc_id are not drawn.
    """
    known = lambda name, kind: F.coalesce(F.col(name).cast(kind), F.lit(-1).cast(kind)) if name in corpus.columns else F.lit(-1).cast(kind)
    place = F.min(F.struct(known("severity_level", "double").alias("level"), known("year", "int").alias("year"))).alias("p")
    ids = corpus.where("doc_id is not null").groupBy("doc_id").agg(place).select("doc_id", F.col("p.level").alias("_level"), F.col("p.year").alias("_year"))
    cells = {(r[0], r[1]): r[2] for r in ids.groupBy("_level", "_year").agg(F.count(F.lit(1))).collect()}
    sizes: Counter = Counter()
    for (level, _), size in cells.items():
        sizes[level] += size
    quotas = level_quotas(sizes, n, floors or {})
    rows = []
    for level, quota in quotas.items():
        own = sorted(c for c in cells if c[0] == level)
        caps = [cells[c] for c in own]
        rows += [(*c, q, cells[c], sizes[level] / quota) for c, q in zip(own, largest_remainder(caps, quota, [0] * len(own), caps)) if q]
    wanted = corpus.sparkSession.createDataFrame(rows, "_level double, _year int, quota int, cell_rows bigint, sampling_weight double")
    drawn = smallest_keys(ids, wanted, ["_level", "_year"], "doc_id", seed).select("doc_id", "_level", "_year", "sampling_weight")
    found = corpus.join(F.broadcast(drawn) if n <= BROADCAST_CELLS else drawn, "doc_id")
    same = found.where((known("severity_level", "double") == F.col("_level")) & (known("year", "int") == F.col("_year")))
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in corpus.columns]))
    return same.withColumn("_first", F.row_number().over(first)).where("_first = 1").select(*corpus.columns, "sampling_weight").orderBy("doc_id")
