"""Samples that match target shares of categories.

Each plan names a sample size and, for one or more fields, the share and the least number of rows of
every category. Categories are counted once; integer quotas come from the largest remainder with
minimum floors and caps at what is available. Where a plan has several fields, their quotas are margins
of one sample: the table of joint cells is fitted to the margins in proportion to what is available
(iterative proportional fitting) and rounded by largest remainder under the cells' caps. From each cell
the rows with the smallest random keys are taken (``smallest_keys``: only the rows around the cell's
threshold are ranked, so a cell with a third of all rows is never sorted as a whole).

Counts of categories and of joint cells come to the driver: there are as many as the targets have
categories (joint cells: their product, refused over ``MOST_CELLS``), whatever the data.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators.stratified import BROADCAST_CELLS, largest_remainder, smallest_keys

MOST_CELLS = 20_000_000  #: joint cells of one plan that the driver fits
OTHER = "\u0000other"  #: rows whose category has no target


def fit_cells(counts: np.ndarray, margins: list[np.ndarray], total: int, rounds: int = 60, floors: list[np.ndarray] | None = None) -> np.ndarray:
    """Integer quotas of joint cells whose margins come as close to the wanted ones as the counts allow.

    Floors of the categories come before the wanted margins. Where the margins' sums differ, those over
    the total are fitted in proportion.
    """
    x = counts.astype(float)
    total = int(min(total, counts.sum()))
    if total <= 0:
        return np.zeros(counts.shape, np.int64)
    x *= total / x.sum()
    for _ in range(rounds):
        for axis, want in enumerate(margins):
            others = tuple(i for i in range(x.ndim) if i != axis)
            now = x.sum(axis=others)
            ratio = np.divide(want * min(1.0, total / max(1, want.sum())), now, out=np.zeros_like(now), where=now > 0)
            x *= ratio.reshape([-1 if i == axis else 1 for i in range(x.ndim)])
        x = np.minimum(x, counts)
    base = np.floor(x + 1e-9).astype(np.int64)
    room = [want - base.sum(axis=tuple(i for i in range(x.ndim) if i != a)) for a, want in enumerate(margins)]
    left = total - int(base.sum())
    # remainders go to the largest first, only where every margin still has room
    for flat in np.argsort(-(x - base), axis=None, kind="stable"):
        if left <= 0:
            break
        cell = np.unravel_index(flat, x.shape)
        if base[cell] < counts[cell] and x[cell] > 0 and all(room[a][cell[a]] > 0 for a in range(x.ndim)):
            base[cell] += 1
            left -= 1
            for a in range(x.ndim):
                room[a][cell[a]] -= 1
    return repair_cells(base, counts, margins, floors or [np.zeros(len(m), np.int64) for m in margins], total)


def repair_cells(base: np.ndarray, counts: np.ndarray, margins: list[np.ndarray], floors: list[np.ndarray], total: int) -> np.ndarray:
    """Rounded quotas after adding, taking and moving single rows while that brings the margins closer.

    The total comes first, then rows missing to a floor, then rows off a wanted margin. Every step lowers
    that sum, so it ends.
    """
    base, d = base.copy(), base.ndim
    heavy = 4.0 * d
    fill = 4 * d * heavy

    def off(a: int, rows: np.ndarray) -> np.ndarray:
        return heavy * np.maximum(0, floors[a] - rows) + np.abs(margins[a] - rows)

    def spread(parts: list[np.ndarray], axes: list[int], allowed: np.ndarray) -> np.ndarray:
        out = np.where(allowed, 0.0, -np.inf)
        for a in axes:
            out = out + parts[a].reshape([-1 if i == a else 1 for i in range(d)])
        return out

    subsets = [[a for a in range(d) if s >> a & 1] for s in range((1 << d) - 1, 0, -1)]
    while True:
        rows = [base.sum(axis=tuple(i for i in range(d) if i != a)) for a in range(d)]
        more = [off(a, rows[a]) - off(a, rows[a] + 1) for a in range(d)]
        less = [off(a, rows[a]) - off(a, rows[a] - 1) for a in range(d)]
        can_add, can_take = base < counts, base > 0
        gap = total - int(base.sum())
        best, step = 1e-9, None
        if gap:
            gain = spread(more if gap > 0 else less, subsets[0], can_add if gap > 0 else can_take) + fill
            k = int(np.argmax(gain))
            if gain.flat[k] > best:
                best, step = gain.flat[k], ((k, 1),) if gap > 0 else ((k, -1),)
        if step is None:
            # from one cell to another that differs in the given axes and shares the rest
            for axes in subsets:
                up, down = spread(more, axes, can_add), spread(less, axes, can_take)
                gain = up.max(axis=tuple(axes), keepdims=True) + down.max(axis=tuple(axes), keepdims=True)
                k = int(np.argmax(gain))
                if gain.flat[k] > best:
                    at = np.unravel_index(k, gain.shape)
                    here = np.ones(base.shape, bool)
                    for a in range(d):
                        if a not in axes:
                            here &= (np.arange(base.shape[a]) == at[a]).reshape([-1 if i == a else 1 for i in range(d)])
                    best, step = gain.flat[k], ((int(np.argmax(np.where(here, up, -np.inf))), 1), (int(np.argmax(np.where(here, down, -np.inf))), -1))
        if step is None:
            return base
        for k, by in step:
            base.flat[k] += by


def category_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """field_name, category, available: distinct keys of each category. ``rows``: key, field_name, category; nulls are no category."""
    return rows.where("category is not null").select(key, "field_name", "category").distinct().groupBy("field_name", "category").agg(F.count(F.lit(1)).alias("available"))


def target_shortfalls(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """Every target with what is available, wanted (target_share * sample_size), missing and met.

    A target is met when as many rows are available as its share and its minimum ask for. A null share
    or minimum asks for nothing. Targets repeated in the table are reported once.
    """
    need = F.coalesce(F.col("target_share").cast("decimal(20,10)") * F.col("sample_size").cast("decimal(18,0)"), F.lit(0).cast("decimal(38,10)"))
    least = F.coalesce("min_rows", F.lit(0))
    t = targets.select("plan_id", "sample_size", "field_name", "category", "target_share", "min_rows").distinct()
    joined = t.join(counts, ["field_name", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    return joined.select(
        "plan_id", "field_name", "category", "sample_size", "target_share", "min_rows", "available", need.cast("double").alias("wanted"),
        F.greatest(F.ceil(need) - F.col("available"), least - F.col("available"), F.lit(0)).cast("bigint").alias("missing"), ((F.col("available") >= need) & (F.col("available") >= least)).alias("met"),
    )


def corpus_categories(corpus: DataFrame, extracted: DataFrame) -> DataFrame:
    """doc_id, field_name, category of a corpus: state trimmed and upper-cased, year as digits, technology_type of judgements that parsed."""
    state = F.nullif(F.upper(F.btrim("state", F.lit(" \t\r\n"))), F.lit(""))
    pair = lambda name, c: F.struct(F.lit(name).alias("field_name"), c.alias("category"))
    own = corpus.select("doc_id", F.explode(F.array(pair("state", state), pair("year", F.col("year").cast("string")))).alias("p")).select("doc_id", "p.field_name", "p.category")
    typed = extracted.where("parse_ok and technology_type is not null").select("doc_id", F.lit("technology_type").alias("field_name"), F.col("technology_type").alias("category"))
    return own.unionByName(typed.join(corpus.select("doc_id"), "doc_id", "left_semi"))


def corpus_rows(corpus: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row for each doc_id with state, year and technology_type; of several judgements the most confident that parsed (then the first by name)."""
    best = extracted.where("parse_ok and technology_type is not null").groupBy("doc_id").agg(F.min(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "technology_type"))["technology_type"].alias("technology_type"))
    state = F.nullif(F.upper(F.btrim("state", F.lit(" \t\r\n"))), F.lit(""))
    base = corpus.where("doc_id is not null").groupBy("doc_id").agg(F.min(state).alias("state"), F.min(F.col("year").cast("string")).alias("year"))
    return base.join(best, "doc_id", "left")


def _plans(targets: DataFrame) -> dict[int, dict]:
    """Size and, by field, (category, share, minimum) of every plan."""
    plans: dict[int, dict] = {}
    for t in targets.where("plan_id is not null and field_name is not null and category is not null").select("plan_id", "sample_size", "field_name", "category", "target_share", "min_rows").distinct().orderBy("plan_id", "field_name", "category").collect():
        p = plans.setdefault(t["plan_id"], {"size": t["sample_size"] or 0, "fields": defaultdict(list)})
        p["fields"][t["field_name"]].append((t["category"], t["target_share"] or 0.0, t["min_rows"] or 0))
    return plans


def draw_samples(rows: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """plan_id, key and the fields of every drawn row.

    ``rows``: one row for each key with a column for each field of the targets. Rows without a targeted
    category in some field of a plan are not drawn for it. Minimum rows come before shares; minimums of a
    field that add up to more than the sample are cut in proportion (and reported). Where targets cannot be
    met the sample is smaller, never padded with other categories. The draw depends on seed and keys only,
    not on how the table is partitioned. Empty tables give an empty sample.
    """
    spark = rows.sparkSession
    plans = _plans(targets)
    fields = sorted({f for p in plans.values() for f in p["fields"]})
    named = {f: {c for p in plans.values() for c, _, _ in p["fields"].get(f, [])} for f in fields}
    if not plans:
        return rows.select(F.lit(None).cast("int").alias("plan_id"), key).where(F.lit(False))
    coded = rows.select(key, *[F.when(F.col(f).isin(*sorted(named[f])), F.col(f)).otherwise(OTHER).alias(f) for f in fields])
    counts = coded.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()
    by_fields: dict[tuple, list] = defaultdict(list)  # plans with the same fields share one equi-join
    for plan, p in plans.items():
        own = sorted(p["fields"])
        axis = {f: {c: i for i, (c, _, _) in enumerate(p["fields"][f])} for f in own}
        shape = [len(axis[f]) for f in own]
        if np.prod(shape, dtype=float) > MOST_CELLS:
            raise ValueError(f"plan {plan} has more than {MOST_CELLS} joint cells")
        cells = np.zeros(shape, np.int64)
        for r in counts:
            if all(r[f] in axis[f] for f in own):
                cells[tuple(axis[f][r[f]] for f in own)] += r["n"]
        margins, floors = [], []
        for a, f in enumerate(own):
            caps = cells.sum(axis=tuple(i for i in range(cells.ndim) if i != a)).tolist()
            least = [min(m, c) for (_, _, m), c in zip(p["fields"][f], caps)]
            if sum(least) > p["size"]:
                least = largest_remainder(least, p["size"], [0] * len(least), least)
            margins.append(np.array(largest_remainder([s for _, s, _ in p["fields"][f]], p["size"], least, caps)))
            floors.append(np.array(least))
        quota = fit_cells(cells, margins, min(p["size"], *(int(m.sum()) for m in margins)), floors=floors)
        by_fields[tuple(own)] += [(plan, *(p["fields"][f][i][0] for f, i in zip(own, at)), int(q), int(cells[at])) for at, q in np.ndenumerate(quota) if q]
    parts = []
    for own, cells in by_fields.items():
        quotas = spark.createDataFrame(cells, ", ".join(["plan_id int", *[f"`{f}` string" for f in own], "quota int", "cell_rows bigint"]))
        drawn = smallest_keys(coded, quotas, list(own), key, seed, ("plan_id",))
        parts.append(drawn.select("plan_id", key, *[F.col(f) if f in own else F.nullif(F.col(f), F.lit(OTHER)).alias(f) for f in fields]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def sample_report(sample: DataFrame, targets: DataFrame, counts: DataFrame, rows: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Every target held against the sample that was drawn for it.

    wanted is target_share * sample_size, available what the tables hold and drawable (with ``rows``, the
    table the sample was drawn from) what could be drawn, where a row has one category of a field.
    quota is what the field alone would get (largest remainder with floors and caps). A target is ``met``
    when as many rows as wanted and as min_rows were drawn. Otherwise ``reason`` says why, the first that
    applies: available (too few rows), floors (the minimums of its field add up to more than the sample),
    rounding (less than one row short of wanted, minimum kept), floors_of_others (its field's quota is
    under wanted because of minimums of other categories) or joint (the plan's other fields do not leave
    enough rows). short_of_share and short_of_minimum say by how much.
    """
    spark = sample.sparkSession
    fields = [c for c in sample.columns if c not in ("plan_id", key)]
    split = lambda df, *more: df.select(*more, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("category")) for f in fields])).alias("p")).groupBy(*more, "p.field_name", "p.category").agg(F.count(F.lit(1)).alias("n"))
    on = ["plan_id", "field_name", "category"]
    short = target_shortfalls(targets, counts).drop("missing", "met")
    have = {(r["field_name"], r["category"]): r["available"] for r in short.select("field_name", "category", "available").distinct().collect()}
    quotas = []
    for plan, p in _plans(targets).items():
        for f, cats in p["fields"].items():
            caps = [have[f, c] for c, _, _ in cats]
            least = [min(m, c) for (_, _, m), c in zip(cats, caps)]
            over = sum(m for _, _, m in cats) > p["size"]
            if sum(least) > p["size"]:
                least = largest_remainder(least, p["size"], [0] * len(least), least)
            quotas += [(plan, f, c, int(q), over) for (c, _, _), q in zip(cats, largest_remainder([s for _, s, _ in cats], p["size"], least, caps))]
    quota = spark.createDataFrame(quotas, "plan_id int, field_name string, category string, quota bigint, floors_over_size boolean")
    quota = F.broadcast(quota) if len(quotas) <= BROADCAST_CELLS else quota
    out = short.join(quota, on, "left").join(split(sample, "plan_id").withColumnRenamed("n", "drawn"), on, "left").join(sample.groupBy("plan_id").agg(F.count(F.lit(1)).alias("drawn_rows")), "plan_id", "left")
    out = out.join(split(rows, F.lit(0).alias("_")).drop("_").withColumnRenamed("n", "drawable"), on[1:], "left") if rows is not None else out.withColumn("drawable", F.col("available"))
    out = out.na.fill(0, ["drawn", "quota", "drawable"]).withColumn("drawn_share", F.try_divide("drawn", "drawn_rows")).drop("drawn_rows")
    least = F.coalesce("min_rows", F.lit(0))
    out = out.withColumn("short_of_share", F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0.0))).withColumn("short_of_minimum", F.greatest(least - F.col("drawn"), F.lit(0)).cast("bigint"))
    met = (F.col("short_of_share") <= 1e-9) & (F.col("short_of_minimum") == 0)
    reason = (
        F.when(met, None).when((F.col("drawable") < F.col("wanted") - 1e-9) | (F.col("drawable") < least), "available").when((F.col("short_of_minimum") > 0) & F.col("floors_over_size"), "floors")
        .when((F.col("short_of_share") < 1) & (F.col("short_of_minimum") == 0), "rounding").when((F.col("quota") < F.floor("wanted")) & (F.col("drawn") >= F.col("quota")), "floors_of_others").otherwise("joint")
    )
    return out.withColumn("met", met).withColumn("reason", reason)
