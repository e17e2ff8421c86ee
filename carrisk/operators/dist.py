"""Distribution summaries: the statistics behind the pipeline's figures.

Each returns a small table computed on the cluster; cost is one or two
aggregate passes regardless of row count.  Range bounds over all groups are
fetched as scalars and inlined as literals; what is per group (bandwidths,
quartiles) stays in a frame with a row per group and is joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrisk.operators import rank
from carrisk.session import checkpoint


def _keyed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, NULL keys included; the keys come once."""
    side = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(side, cond).drop(*[f"_k{i}" for i in range(len(keys))])


def _x(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def prepare(df: DataFrame, value: str | Column, keys: Sequence[str] = (), log10: bool = False,
            keep_between: tuple[float | None, float | None] | None = None) -> DataFrame:
    """(keys..., x): drop NULL / non-finite, optional axis limits, then optional log10.

    Axis limits drop rows outside the closed range ``[lo, hi]`` before the
    statistic and a log axis transforms before it, so both are applied here
    (F15).  Open-interval row filters belong to the caller.
    """
    x = _x(value)
    out = df.select(*keys, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    if keep_between is not None:
        lo, hi = keep_between
        if lo is not None:
            out = out.where(F.col("x") >= F.lit(float(lo)))
        if hi is not None:
            out = out.where(F.col("x") <= F.lit(float(hi)))
    if log10:
        out = out.where(F.col("x") > 0).withColumn("x", F.log10("x"))
    return out


def histogram(df: DataFrame, value: str | Column, bins: int = 60, log10: bool = False,
              keys: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins centred on the data min and max (width =
    range / (bins - 1)), right-closed; one row per non-empty bin.

    Columns: keys..., bin, x_mid, x_lo, x_hi, n  (x in log10 units if ``log10``).
    """
    x = prepare(df, value, keys, log10)
    rng = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if rng["lo"] is None:
        return x.select(*keys, F.lit(0).alias("bin"), F.col("x").alias("x_mid"), F.col("x").alias("x_lo"),
                        F.col("x").alias("x_hi"), F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi = float(rng["lo"]), float(rng["hi"])
    width = (hi - lo) / (bins - 1) if hi > lo else 1.0
    origin = lo - width / 2.0
    k = F.greatest(F.ceil((F.col("x") - F.lit(origin)) / F.lit(width)) - 1, F.lit(0)).cast("int")
    counts = x.groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "bin",
                         (F.lit(lo) + F.col("bin") * F.lit(width)).alias("x_mid"),
                         (F.lit(origin) + F.col("bin") * F.lit(width)).alias("x_lo"),
                         (F.lit(origin) + (F.col("bin") + 1) * F.lit(width)).alias("x_hi"),
                         "n")


def _nrd0(sd: str, iqr: str, n: str, least: str) -> Column:
    """R's default bandwidth as a column: 0.9 min(sd, IQR / 1.34) n^-0.2, with its fallbacks for 0."""
    hi = F.coalesce(F.col(sd), F.lit(0.0))
    lo = F.least(hi, F.coalesce(F.col(iqr), F.lit(0.0)) / F.lit(1.34))
    lo = F.when(lo != 0, lo).when(hi != 0, hi).when(F.col(least) != 0, F.abs(F.col(least))).otherwise(F.lit(1.0))
    return F.lit(0.9) * lo * F.pow(F.col(n).cast("double"), F.lit(-0.2))


def kde(df: DataFrame, value: str | Column, keys: Sequence[str] = (), grid: int = 512,
        fine_bins: int = 2048, log10: bool = False,
        keep_between: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Gaussian density per group on a shared ``grid``-point range.

    Rows are binned into ``fine_bins`` bins over the common range (one hash
    aggregate); each group's bounded histogram is then convolved with the
    kernel on the grid inside the JVM with array higher-order functions, so
    the cost after the first pass does not depend on the row count.
    Bandwidth is nrd0 per group.  The grid spans the data range over all
    groups, or the axis limits when ``keep_between`` gives both ends.
    Columns: keys..., x, density, n, bw.
    """
    x = prepare(df, value, keys, log10, keep_between)
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends["lo"] is None:
        return x.select(*keys, F.col("x"), F.col("x").alias("density"), F.lit(0).cast("long").alias("n"),
                        F.col("x").alias("bw")).limit(0)
    lo, hi = float(ends["lo"]), float(ends["hi"])
    if keep_between is not None and None not in keep_between and not log10:
        lo, hi = float(keep_between[0]), float(keep_between[1])
    span = hi - lo if hi > lo else 1.0
    fw = span / fine_bins
    step = span / (grid - 1) if grid > 1 else 0.0
    spread = x.groupBy(*keys).agg(F.stddev_samp("x").alias("sd"), F.min("x").alias("least"))
    quart = rank.quantiles(x, {"x": "x"}, [0.25, 0.75], keys).select(*keys, "n", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    stats = _keyed(spread, quart, keys).select(*keys, "n", _nrd0("sd", "iqr", "n", "least").alias("bw"))
    fb = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(fw)), F.lit(fine_bins - 1)).cast("int")
    binned = x.groupBy(*keys, fb.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    hist = binned.groupBy(*keys).agg(F.collect_list(F.struct("b", "c")).alias("h"))
    hist = _keyed(hist, stats, keys)
    inv = 1.0 / math.sqrt(2 * math.pi)
    dens = F.transform(
        F.sequence(F.lit(0), F.lit(grid - 1)),
        lambda i: F.struct(
            (F.lit(lo) + i * F.lit(step)).alias("x"),
            F.aggregate(
                F.col("h"), F.lit(0.0),
                lambda acc, e: acc + e["c"] * F.exp(
                    -0.5 * F.pow(((F.lit(lo) + i * F.lit(step)) - (F.lit(lo) + (e["b"] + 0.5) * F.lit(fw)))
                                 / F.col("bw"), 2))
            ).alias("s")))
    out = hist.select(*keys, "bw", "n", F.inline(dens))
    return out.select(*keys, "x", (F.col("s") * F.lit(inv) / (F.col("n") * F.col("bw"))).alias("density"),
                      "n", "bw")


def bin2d(df: DataFrame, xcol: str | Column, ycol: str | Column, bins: int = 50,
          log10: bool = False, keys: Sequence[str] = (), log_x: bool | None = None,
          log_y: bool | None = None) -> DataFrame:
    """D3: square 2-D bins over each axis range; counts per occupied cell.
    ``log10`` puts both axes on a log scale; ``log_x``/``log_y`` choose per axis."""
    lx = log10 if log_x is None else log_x
    ly = log10 if log_y is None else log_y
    x, y = _x(xcol), _x(ycol)
    src = df.select(*keys, x.alias("x"), y.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if lx:
        src = src.where(F.col("x") > 0).withColumn("x", F.log10("x"))
    if ly:
        src = src.where(F.col("y") > 0).withColumn("y", F.log10("y"))
    r = src.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if r[0] is None:
        return src.select(*keys, F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(0).cast("long").alias("n")).limit(0)
    xl, xh, yl, yh = (float(v) for v in r)
    wx = (xh - xl) / bins if xh > xl else 1.0
    wy = (yh - yl) / bins if yh > yl else 1.0
    bx = F.least(F.floor((F.col("x") - F.lit(xl)) / F.lit(wx)), F.lit(bins - 1)).cast("int")
    by = F.least(F.floor((F.col("y") - F.lit(yl)) / F.lit(wy)), F.lit(bins - 1)).cast("int")
    return src.groupBy(*keys, bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("n"))


def hex_bin2d(df: DataFrame, xcol: str | Column, ycol: str | Column, bins: int = 50, keys: Sequence[str] = (),
              log_x: bool = False, log_y: bool = False) -> DataFrame:
    """D3: hexagonal 2-D bins; one row per occupied hexagon.

    A hexagon is ``range / bins`` wide on each axis (pointed at the top; rows of
    centres lie sqrt(3) / 2 of a width apart), and the lattice starts at a
    multiple of the width at or below the least value, less 1e-6.  A point goes to the nearest centre:
    its axial coordinates are rounded as a cube, and of the three rounded
    numbers the one that moved most is set so that they sum to 0.  Rows with a NULL
    or NaN value, or one of 0 or less on a log axis, are left out; an axis of one
    value counts as 1 wide.  One scan for the ranges, one hash aggregate.

    Columns: keys..., hq, hr (axial coordinates), x_mid, y_mid (the centre, in log10 units on a log axis), n.
    """
    src = df.select(*keys, _x(xcol).alias("_hx"), _x(ycol).alias("_hy"))
    src = src.where(F.col("_hx").isNotNull() & F.col("_hy").isNotNull() & ~F.isnan("_hx") & ~F.isnan("_hy"))
    for c, log in (("_hx", log_x), ("_hy", log_y)):
        if log:
            src = src.where(F.col(c) > 0).withColumn(c, F.log10(c))
    least_x, most_x, least_y, most_y = src.agg(F.min("_hx"), F.max("_hx"), F.min("_hy"), F.max("_hy")).first()
    if least_x is None:
        return src.select(*keys, F.lit(0).cast("long").alias("hq"), F.lit(0).cast("long").alias("hr"), F.col("_hx").alias("x_mid"),
                          F.col("_hy").alias("y_mid"), F.lit(0).cast("long").alias("n")).limit(0)
    wx, wy = ((hi - lo) / bins if hi > lo else 1.0 for lo, hi in ((least_x, most_x), (least_y, most_y)))
    ox, oy = (math.floor(lo / w) * w - 1e-6 for lo, w in ((least_x, wx), (least_y, wy)))
    up = math.sqrt(3.0) / 2.0
    row = (F.col("_hy") - F.lit(oy)) / F.lit(wy) / F.lit(up)
    placed = src.select(*keys, row.alias("_r"), ((F.col("_hx") - F.lit(ox)) / F.lit(wx) - row / 2.0).alias("_q"))
    near = placed.withColumns({"_rq": F.floor(F.col("_q") + 0.5), "_rr": F.floor(F.col("_r") + 0.5), "_rs": F.floor(0.5 - F.col("_q") - F.col("_r"))})
    near = near.withColumns({"_dq": F.abs(F.col("_rq") - F.col("_q")), "_dr": F.abs(F.col("_rr") - F.col("_r")),
                             "_ds": F.abs(F.col("_rs") + F.col("_q") + F.col("_r"))})
    q_moved = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
    hq = F.when(q_moved, -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq"))
    hr = F.when(~q_moved & (F.col("_dr") > F.col("_ds")), -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr"))
    counts = near.groupBy(*keys, hq.alias("hq"), hr.alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "hq", "hr", (F.lit(ox) + (F.col("hq") + F.col("hr") / 2.0) * F.lit(wx)).alias("x_mid"),
                         (F.lit(oy) + F.col("hr") * F.lit(up) * F.lit(wy)).alias("y_mid"), "n")


def box_stats(df: DataFrame, value: str | Column, keys: Sequence[str] = (), log10: bool = False,
              keep_between: tuple[float | None, float | None] | None = None, coef: float = 1.5) -> DataFrame:
    """Quartiles (type 7), whiskers at the extreme points within coef*IQR
    of the hinges, outlier count.  Two passes: quartiles per group, then the
    conditional extremes after a join on the (report-size) quartile frame."""
    x = prepare(df, value, keys, log10, keep_between)
    gkeys = list(keys) or ["_all"]
    if not keys:
        x = x.withColumn("_all", F.lit(0))
    q = rank.quantiles(x, {"x": "x"}, [0.25, 0.5, 0.75], gkeys).select(
        *gkeys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    lo_f = F.col("q1") - F.lit(coef) * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + F.lit(coef) * (F.col("q3") - F.col("q1"))
    qk = q.select(*[F.col(k).alias(f"_q_{k}") for k in gkeys], "q1", "q3")
    cond = [x[k].eqNullSafe(qk[f"_q_{k}"]) for k in gkeys]
    ext = x.join(qk, cond, "inner").groupBy(*gkeys).agg(
        F.min(F.when(F.col("x") >= lo_f, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(F.col("x") <= hi_f, F.col("x"))).alias("whisker_hi"),
        F.count_if((F.col("x") < lo_f) | (F.col("x") > hi_f)).alias("n_outliers"))
    ek = ext.select(*[F.col(k).alias(f"_e_{k}") for k in gkeys], "whisker_lo", "whisker_hi", "n_outliers")
    out = q.join(ek, [q[k].eqNullSafe(ek[f"_e_{k}"]) for k in gkeys], "inner").drop(*[f"_e_{k}" for k in gkeys])
    return out if keys else out.drop("_all")


def loglog_fit(df: DataFrame, xcol: str, ycol: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of log10(y) on log10(x) per group, finite rows only."""
    src = df.where((F.col(xcol) > 0) & (F.col(ycol) > 0)).select(
        *keys, F.log10(_x(xcol)).alias("lx"), F.log10(_x(ycol)).alias("ly"))
    return src.groupBy(*keys).agg(
        F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"),
        F.regr_r2("ly", "lx").alias("r2"), F.regr_count("ly", "lx").alias("n"))


def ellipse_params(df: DataFrame, xcol: str, ycol: str, keys: Sequence[str] = (), level: float = 0.90) -> DataFrame:
    """Normal-theory confidence ellipse per group: centre, covariance and radius.

    radius = sqrt(2 * F quantile(level; 2, n - 1)), NULL for fewer than 4 rows.
    """
    return df.groupBy(*keys).agg(
        F.avg(_x(xcol)).alias("cx"), F.avg(_x(ycol)).alias("cy"),
        F.var_samp(_x(xcol)).alias("var_x"), F.var_samp(_x(ycol)).alias("var_y"),
        F.covar_samp(_x(xcol), _x(ycol)).alias("cov_xy"), F.count(F.lit(1)).alias("n"),
    ).withColumn("radius", _f_radius(level))


def _f_radius(level: float) -> Column:
    """sqrt(2 * F quantile(level; 2, n - 1)) of column ``n``; with 2 degrees in the numerator the quantile has a closed form."""
    d = F.col("n").cast("double") - 1.0
    return F.when(F.col("n") >= 4, F.sqrt(d * (F.pow(F.lit(1.0 - level), -2.0 / d) - 1.0)))


#: A covariance whose determinant is at most this share of var_x * var_y has no inverse.
FLAT = 1e-12


def _flat(vx: Column, vy: Column, cxy: Column) -> Column:
    return ~F.coalesce(vx * vy - cxy * cxy > F.lit(FLAT) * vx * vy, F.lit(False))


def t_ellipse(df: DataFrame, xcol: str | Column, ycol: str | Column, keys: Sequence[str] = (), level: float = 0.90,
              nu: float = 5.0, tol: float = 0.01, max_iter: int = 25) -> DataFrame:
    """Confidence ellipse per group from a multivariate-t centre and scatter (``nu`` degrees of freedom).

    Iteratively reweighted: a row's weight is (nu + 2) / (nu + its squared distance in
    the group's current covariance), so far rows lose their pull.  A round is one
    hash aggregate over the rows of the groups still moving; a group ends when
    no weight moved by ``tol``, or after ``max_iter`` rounds.  Per group only sums and two
    five-number states exist, kept in a checkpointed frame; a group of a third of all rows is partial sums
    before the shuffle.  The driver sees whether any group is left.

    Columns: keys..., cx, cy, var_x, var_y, cov_xy, n, rounds, radius.  Rows with a NULL
    or NaN value are left out; NULL keys are a group.  Groups of fewer than 4 rows or on a line keep their
    plain mean and covariance (0 rounds), the former with a NULL radius.
    """
    rows = df.select(*keys, _x(xcol).alias("_x"), _x(ycol).alias("_y"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    gk = list(keys) or ["_all"]
    rows = checkpoint(rows if keys else rows.withColumn("_all", F.lit(0)))
    now, before, found = (tuple(f"_{kind}{c}" for c in ("mx", "my", "vx", "vy", "cxy")) for kind in ("now_", "old_", "out_"))
    ended = (F.col("n") < 4) | _flat(*map(F.col, now[2:]))
    state = rows.groupBy(*gk).agg(F.avg("_x").alias(now[0]), F.avg("_y").alias(now[1]), F.var_pop("_x").alias(now[2]), F.var_pop("_y").alias(now[3]),
                                  F.covar_pop("_x", "_y").alias(now[4]), F.var_samp("_x").alias(found[2]), F.var_samp("_y").alias(found[3]),
                                  F.covar_samp("_x", "_y").alias(found[4]), F.count(F.lit(1)).alias("n"))
    columns = [*gk, "n", *now, *before, *found, "rounds", "_ended"]
    state = checkpoint(state.withColumns({**{c: F.lit(None).cast("double") for c in before}, found[0]: F.col(now[0]), found[1]: F.col(now[1]),
                                          "rounds": F.lit(0), "_ended": ended}).select(*columns))

    def weight(of: tuple[str, ...]) -> Column:
        mx, my, vx, vy, cxy = map(F.col, of)
        dx, dy = F.col("_x") - mx, F.col("_y") - my
        return F.lit(nu + 2.0) / (F.lit(nu) + (vy * dx * dx - 2.0 * cxy * dx * dy + vx * dy * dy) / (vx * vy - cxy * cxy))

    for i in range(1, max_iter + 1):
        live = state.where(~F.col("_ended"))
        if live.isEmpty():
            break
        seen = _keyed(rows, live.select(*gk, *now, *before), gk).withColumns({
            "_w": weight(now), "_dx": F.col("_x") - F.col(now[0]), "_dy": F.col("_y") - F.col(now[1])})
        moved = F.abs(F.col("_w") - (F.lit(1.0) if i == 1 else weight(before)))
        w, dx, dy = F.col("_w"), F.col("_dx"), F.col("_dy")
        sums = seen.groupBy(*gk).agg(*[F.max(c).alias(c) for c in now], F.sum(w).alias("_sw"), (F.sum(w * dx) / F.sum(w)).alias("_ax"),
                                     (F.sum(w * dy) / F.sum(w)).alias("_ay"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy"),
                                     F.sum(w * dx * dy).alias("_xy"), F.max(moved).alias("_moved"), F.count(F.lit(1)).alias("n"))
        ax, ay, sw = F.col("_ax"), F.col("_ay"), F.col("_sw")
        new = dict(zip(now, (F.col(now[0]) + ax, F.col(now[1]) + ay, F.col("_xx") / sw - ax * ax, F.col("_yy") / sw - ay * ay, F.col("_xy") / sw - ax * ay)))
        out = dict(zip(found, (new[now[0]], new[now[1]], F.col("_xx") / F.col("n"), F.col("_yy") / F.col("n"), F.col("_xy") / F.col("n"))))
        end = (F.col("_moved") < tol) | _flat(*(new[c] for c in now[2:]))
        step = sums.select(*gk, "n", *[new[c].alias(c) for c in now], *[F.col(a).alias(b) for a, b in zip(now, before)],
                           *[out[c].alias(c) for c in found], F.lit(i).alias("rounds"), end.alias("_ended"))
        state = checkpoint(step.unionByName(state.where("_ended")))
    result = state.select(*gk, *[F.col(a).alias(b) for a, b in zip(found, ("cx", "cy", "var_x", "var_y", "cov_xy"))], "n", "rounds", _f_radius(level).alias("radius"))
    return result if keys else result.drop("_all")


def capped_hash_sample(df: DataFrame, key: str, cap: int, seed: int = 42) -> DataFrame:
    """The ``cap`` rows with the smallest md5(key|seed) -- a deterministic
    sample; a top-k, so only ``cap`` rows per task move."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(cap).drop("_h")


def quantile_limits(ref: DataFrame, probs: dict[str, float]) -> dict[str, float | None]:
    """Upper axis limits at quantiles of a reference frame (one aggregate, scalars back)."""
    wanted = sorted(set(probs.values()))
    found = {r["column"]: r["q"] for r in rank.quantiles(ref, {c: c for c in probs}, wanted).collect()}
    return {c: found[c][wanted.index(q)] if c in found else None for c, q in probs.items()}


def trimmed_rows(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows inside closed axis limits on every listed column (what a plot with
    those limits keeps)."""
    cond = F.lit(True)
    for c, (lo, hi) in limits.items():
        if lo is not None:
            cond = cond & (_x(c) >= F.lit(float(lo)))
        if hi is not None:
            cond = cond & (_x(c) <= F.lit(float(hi)))
    return df.where(cond)


def trimmed_sample(df: DataFrame, key: str, limits: dict[str, tuple[float | None, float | None]],
                   cap: int | None = None, seed: int = 42) -> DataFrame:
    """Limit-trimmed rows, optionally capped with a deterministic hash sample."""
    out = trimmed_rows(df, limits)
    return capped_hash_sample(out, key, cap, seed) if cap else out
