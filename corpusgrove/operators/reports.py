"""Reports over a grouped corpus.

Per-group tables are small next to the corpus but grow with the number of
groups, so a group list only becomes a broadcast value behind a size check
(see :mod:`corpusgrove.operators.assign`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..functions import vectors as V
from . import assign
from .filters import compile_criteria, parse_id_list
from .search import truncate_text

SCATTER_CAP = 20000   # rows per set before sampling (fixed value of the reference)
SCATTER_MIN_PER_GROUP = 3
TREND_BINS = 100      # adaptive bin count (fixed value of the reference)


# ------------------------------------------------------------------ E14
def group_neighbours(summaries: DataFrame, group: int, max_distance, k: int = 5) -> DataFrame:
    """The k nearest other groups of one group: group, distance, score,
    repr_text. The pivot group is excluded by id (the reference drops rank 0).
    ``max_distance`` is a number or a one-row DataFrame with that column."""
    if group is None or group < 0:
        raise ValueError("group must be a non-negative group id")
    pivot = summaries.where(F.col("group") == group).select(V.as_double("mean").alias("p")).scalar()
    md = _max_distance_col(max_distance)
    return (summaries.where(F.col("group") != group)
            .withColumn("_p", pivot)
            .select("group", V.euclidean("mean", "_p").alias("distance"), "repr_text")
            .withColumn("score", F.try_divide(F.col("distance"), md))
            .orderBy("distance", "group").limit(k))


def group_row(summaries: DataFrame, group: int) -> DataFrame:
    """E14 second part: the group's own row without its mean."""
    return summaries.where(F.col("group") == group).drop("mean")


def all_group_neighbours(summaries: DataFrame, max_distance, k: int = 5) -> DataFrame:
    """E14 for every group at once: (group, rank, neighbour, distance, score).
    Reuses the size-checked centroid scoring of C3 with k+1 and drops self."""
    rows = summaries.select(F.col("group").cast("long").alias("row_id"), "mean")
    near = assign.nearest_groups(rows, summaries, k=k + 1, vec="mean")
    md = _max_distance_col(max_distance)
    others = F.filter("top", lambda t: t["g"] != F.col("row_id").cast("int"))
    return (near.select(F.col("row_id").cast("int").alias("group"),
                        F.posexplode(F.slice(others, 1, k)).alias("pos", "t"))
            .select("group", (F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("t.g").alias("neighbour"), F.col("t.d").alias("distance"))
            .withColumn("score", F.try_divide(F.col("distance"), md)))


def _max_distance_col(max_distance):
    if isinstance(max_distance, DataFrame):
        return max_distance.select("max_distance").scalar()
    if max_distance is None:
        return F.lit(None).cast("double")
    return F.lit(float(max_distance))


# ------------------------------------------------------------------ E15
def text_similarity(corpus: DataFrame, ids, pivot_id: int, max_distance, set_name: str = "train",
                    vec: str = "reduced", clamp: bool = False) -> DataFrame:
    """``1 - d / max_distance`` between each picked row and one pivot
    row, joined by id (fixes Q17). ``ids`` is a list or DataFrame(row_id);
    ``None`` means every row of the set."""
    rows = corpus.where(F.col("set") == set_name)
    pivot = rows.where(F.col("row_id") == pivot_id).select(V.as_double(vec).alias("p")).scalar()
    if ids is not None:
        if not isinstance(ids, DataFrame):
            ids = corpus.sparkSession.createDataFrame([(int(i),) for i in ids], "row_id long")
        rows = rows.join(ids.select("row_id").distinct(), "row_id", "left_semi")
    md = _max_distance_col(max_distance)
    sim = F.lit(1.0) - F.try_divide(V.euclidean(vec, "_p"), md)
    if clamp:
        sim = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim))
    return rows.withColumn("_p", pivot).select("row_id", sim.alias("similarity"))


# ------------------------------------------------------------------ E16 / E17
def scatter_sample(df: DataFrame, criteria: str | None = None, hide_filtered: bool = False,
                   cap: int = SCATTER_CAP, num_group: int | None = None) -> DataFrame:
    """Id, text[0:80], x, y, ref, predict, filtered for one set.

    Rows without predict are left out. When more than ``cap`` rows remain,
    only the first ``max(3, cap // num_group)`` rows by id of each group are
    kept; the per-group limit is a literal, so Spark plans it as a
    WindowGroupLimit that trims each group map-side before the shuffle.
    """
    pred = compile_criteria(criteria)
    rows = df
    if hide_filtered and pred is not None:
        rows = rows.where(pred)
    rows = rows.where(F.col("predict").isNotNull())
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(
        F.when(F.col("predict") != -1, F.col("predict"))).alias("g")).first()
    if stats["n"] > cap:
        ng = num_group if num_group is not None else max(int(stats["g"]), 1)
        per_group = max(SCATTER_MIN_PER_GROUP, cap // ng)
        w = Window.partitionBy("predict").orderBy("row_id")
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_group).drop("_rn")
    flag = F.lit(False)
    if pred is not None and not hide_filtered:
        flag = ~F.coalesce(pred, F.lit(False))
    return rows.select(F.col("row_id").alias("id"), truncate_text("text").alias("text"), "x", "y",
                       "ref", "predict", flag.alias("filtered"))


def groups_matching(df: DataFrame, criteria: str | None = None) -> DataFrame:
    """Distinct groups of the filtered rows, noise included, NULL out."""
    pred = compile_criteria(criteria) if criteria else None
    rows = df if pred is None else df.where(pred)
    return (rows.where(F.col("predict").isNotNull())
            .select(F.col("predict").alias("group")).distinct().orderBy("group"))


# ------------------------------------------------------------------ E18 / E19
def _epoch() -> F.Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(col) -> F.Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), F.col(col) if isinstance(col, str) else col)


def time_bins(df: DataFrame, ts: str = "ts", nbins: int = TREND_BINS) -> DataFrame:
    """Adaptive buckets. More than ``nbins`` distinct timestamps: equal
    width, right-closed bins labelled by their left edge (the first left edge
    sits range/1000 below the minimum), in integer microseconds; otherwise
    the timestamp itself. Whether there are more is told by the first
    ``nbins + 1`` distinct ones, not by an exact count. NULL counts as none."""
    if df.select(ts).where(F.col(ts).isNotNull()).distinct().limit(nbins + 1).count() <= nbins:
        return df.withColumn("bucket", F.col(ts))
    st = df.agg(F.min(_micros(ts)).alias("lo"), F.max(_micros(ts)).alias("hi")).first()
    lo, hi = int(st["lo"]), int(st["hi"])
    span = hi - lo
    width = span / nbins
    idx = F.greatest(F.ceil((_micros(ts) - F.lit(lo)) / F.lit(width)) - 1, F.lit(0))
    idx = F.least(idx, F.lit(nbins - 1))
    left = F.when(idx == 0, F.lit(lo - span / 1000.0)).otherwise(F.lit(lo) + idx * F.lit(width))
    label = F.timestamp_add("MICROSECOND", F.floor(left).cast("long"), _epoch())
    return df.withColumn("bucket", label)


def group_trend(rows: DataFrame, labels: DataFrame | None = None, ts: str = "ts", group: str = "predict",
                nbins: int = TREND_BINS, dedupe: bool = True) -> DataFrame:
    """Counts per (bucket, group) over time.

    Rows with NULL ts or group are left out (fixes Q18b). With ``dedupe``
    (default, as the reference) duplicate (ts, group) pairs count once;
    ``dedupe=False`` counts rows. ``labels`` (group, repr_text) adds the
    group's text, first 80 characters, '' for noise.
    """
    base = rows.select(F.col(ts).alias("ts"), F.col(group).alias("group")).where(
        F.col("ts").isNotNull() & F.col("group").isNotNull())
    if dedupe:
        # read by the bin edges and by the counts: written once
        base = materialize(base.dropDuplicates(["ts", "group"]))
    binned = time_bins(base, "ts", nbins)
    out = binned.groupBy("bucket", "group").agg(F.count("ts").alias("count"))
    if labels is not None:
        lab = labels.select(F.col("group"), truncate_text("repr_text").alias("label"))
        out = (out.join(lab, "group", "left")
               .withColumn("label", F.when(F.col("group") == -1, F.lit("")).otherwise(F.col("label"))))
    return out


def trend_for_groups(trend: DataFrame, groups: DataFrame) -> DataFrame:
    """Trend rows of the groups matching a filter (semi join on group)."""
    return trend.join(groups.select("group").distinct(), "group", "left_semi")


# ------------------------------------------------------------------ E22 / E25
def layered_points(summaries: DataFrame, train: DataFrame, dev: DataFrame,
                   scored: DataFrame | None = None) -> DataFrame:
    """Groups (size max(20, 100 * radius)), train, dev and scored rows in
    one long table with a ``layer`` column."""
    cols = ["layer", "id", "x", "y", "predict", "size"]
    g = summaries.select(F.lit("group").alias("layer"), F.col("group").cast("long").alias("id"), "x", "y",
                         F.col("group").alias("predict"),
                         F.greatest(F.lit(20.0), 100 * F.col("distance")).alias("size"))
    parts = [g]
    for name, df in (("train", train), ("dev", dev), ("scored", scored)):
        if df is None:
            continue
        parts.append(df.select(F.lit(name).alias("layer"), F.col("row_id").alias("id"), "x", "y",
                               "predict", F.lit(None).cast("double").alias("size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*cols)


def group_detail(corpus: DataFrame, summaries: DataFrame, group: int, max_distance,
                 with_neighbours: bool = True, k: int = 5) -> DataFrame:
    """Rows of a group, optionally with its k nearest groups' rows."""
    ids = [group]
    if with_neighbours:
        near = group_neighbours(summaries, group, max_distance, k).select("group")
        keep = near.unionByName(summaries.sparkSession.createDataFrame([(group,)], "group int"))
        return corpus.join(keep.withColumnRenamed("group", "predict"), "predict", "left_semi")
    pred = parse_id_list(",".join(map(str, ids))).to_column(F.col("predict"))
    return corpus.where(pred)


def group_scatter(corpus: DataFrame, summaries: DataFrame, group: int, max_distance,
                  with_neighbours: bool = True, k: int = 5, cap: int = SCATTER_CAP) -> DataFrame:
    """E25, scatter form: E16 over the rows of :func:`group_detail`."""
    return scatter_sample(group_detail(corpus, summaries, group, max_distance, with_neighbours, k), cap=cap)


def group_detail_trend(corpus: DataFrame, summaries: DataFrame, group: int, max_distance,
                       with_neighbours: bool = True, k: int = 5, nbins: int = TREND_BINS) -> DataFrame:
    """E25, trend form: E18 over the rows of :func:`group_detail`; the bins
    span these rows' times."""
    rows = group_detail(corpus, summaries, group, max_distance, with_neighbours, k)
    return group_trend(rows, summaries, nbins=nbins)
