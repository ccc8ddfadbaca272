"""Box statistics, box-plot table, histograms, status counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalflow.operators.frames import chart_data, list_metrics, metrics_long
from evalflow.sources.store import RunStore

# --- fixed values that must equal the reference's output -----------------
# Score histogram: 10 equal bins over [0, 1], last bin closed.
SCORE_BINS = 10
# Latency histogram: 50 edges spaced evenly over [0, 15] s (49 bins) plus
# one open bin [15, inf); 50 bins in all.
LATENCY_EDGE_POINTS = 50
LATENCY_MAX = 15.0
# --------------------------------------------------------------------------


def score_edges() -> list[float]:
    """NumPy's ``linspace(0, 1, 11)``: ``i * 0.1`` with the last edge exact."""
    step = 1.0 / SCORE_BINS
    return [i * step for i in range(SCORE_BINS)] + [1.0]


def latency_edges() -> list[float]:
    """``linspace(0, 15)`` (50 points, step 15/49, last exactly 15) + inf."""
    step = LATENCY_MAX / (LATENCY_EDGE_POINTS - 1)
    pts = [i * step for i in range(LATENCY_EDGE_POINTS - 1)] + [LATENCY_MAX]
    return pts + [float("inf")]


#: Ranges of equal depth that a group's distinct values are cut into for the ranks, in blocks of ``RANGE_BLOCK``.
RANGES = 256
RANGE_BLOCK = 16
#: Digits of a sum, in base 2 ** DIGIT_BITS: 260 bits from the group's largest magnitude down.
DIGITS, DIGIT_BITS = 13, 20


def _all_combinations(seen: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """recipe x dataset x metric, whether or not it has rows. ``seen`` is a
    small aggregate; the product is the set of facets of the report."""
    pairs = seen.select("recipe").distinct().crossJoin(seen.select("dataset").distinct())
    names = F.array(*[F.lit(m) for m in metrics])
    facets = pairs.select("*", F.explode(names).alias("metric"))
    return facets.select(F.struct("recipe", "dataset", "metric").alias("_k"))


def _range_of(value: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` lie below ``value``: first whole blocks, then within one."""
    blocks = F.transform(F.sequence(F.lit(1), F.lit(RANGES // RANGE_BLOCK - 1)), lambda i: F.get(cuts, i * RANGE_BLOCK - 1))
    whole = F.size(F.filter(blocks, lambda c: c < value)) * RANGE_BLOCK
    return whole + F.size(F.filter(F.slice(cuts, whole + 1, RANGE_BLOCK), lambda c: c < value))


def _quartiles(rows: DataFrame, probs: Sequence[float], sums: Sequence[Column]) -> DataFrame:
    """Linear-interpolation quantiles per ``_k`` from (``_k``, ``value``,
    ``_c``, ``_n``, ``cuts``) rows, one per distinct value, and the given
    aggregates of these rows.

    A value's rank is the count of the smaller ones: the counts of the
    ranges below plus a running count within its own range. The cut points
    come from a quantile sketch of the group's distinct values, so a range
    holds about as many of them as any other, whatever outliers there are:
    no window holds a whole group and no buffer its values.
    """
    rows = rows.withColumn("_p", F.struct("_k", _range_of(F.col("value"), F.col("cuts")).alias("piece"))).drop("cuts")
    within = Window.partitionBy("_p").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    below = Window.partitionBy("_p._k").orderBy("_p.piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("_p").agg(F.sum("_c").alias("_s"))
    pieces = pieces.select(F.col("_p").alias("_pp"), F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_before"))
    start = F.col("_before") + F.col("_in")
    last = start + F.col("_c") - 1
    ranked = rows.join(pieces, F.col("_p") == F.col("_pp"))
    aggs = list(sums)
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for side, r in (("a", F.floor(h)), ("b", F.ceil(h))):
            aggs.append(F.max(F.when((start <= r) & (last >= r), F.col("value"))).alias(f"_{side}{i}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_t{i}"))
    at = ranked.groupBy("_k").agg(*aggs)
    between = lambda i: F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(
        F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_t{i}")
    )
    return at.withColumns({f"_q{i}": between(i) for i in range(len(probs))})


def _finite(value: Column) -> Column:
    return F.abs(value) < float("inf")


def _digit_sums(value: Column, count: Column, top: Column) -> Column:
    """Sums of each digit of the values, as an array from the highest down.

    |value| < 2 ** top; digit i has the weight 2 ** (top - DIGIT_BITS * i).
    Cutting a double into digits is exact, and so are sums of longs.
    """
    base = float(1 << DIGIT_BITS)
    size = F.abs(F.when(_finite(value), value).otherwise(0.0))
    digits = [F.floor((size * F.pow(F.lit(2.0), F.lit(float(DIGIT_BITS * i)) - top)) % F.lit(base)) for i in range(1, DIGITS + 1)]
    return F.array(*[F.sum(F.when(value < 0, -d).otherwise(d) * count) for d in digits])


def _carried(digits: Column) -> Column:
    """The same number with digits from 0 up below the base, but for the first; two more digits in front."""
    wide = F.concat(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), digits)
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))

    def put(state: Column, digit: Column) -> Column:
        whole = state["carry"] + digit
        return F.struct(
            F.shiftright(whole, DIGIT_BITS).alias("carry"),
            F.concat(F.array(whole.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long"))), state["out"]).alias("out"),
        )

    done = F.aggregate(F.reverse(wide), start, put)
    return F.concat(F.array(done["carry"]), done["out"])


def _total(digits: Column, top: Column) -> Column:
    """The sum that ``_digit_sums`` counted, rounded once: six digits from the first that is not 0 make an exact decimal."""
    negative = F.get(_carried(digits), 0) < 0
    plain = _carried(F.transform(digits, lambda d: F.when(negative, -d).otherwise(d)))
    first = F.coalesce(F.get(F.filter(F.transform(plain, lambda d, i: F.when(d != 0, i)), lambda i: i.isNotNull()), 0), F.lit(0))
    first = F.least(first, F.lit(DIGITS + 3 - 6))
    base = F.lit(1 << DIGIT_BITS).cast("decimal(38,0)")
    whole = F.aggregate(
        F.slice(plain, first + 1, 6), F.lit(0).cast("decimal(38,0)"), lambda t, d: (t * base + d.cast("decimal(38,0)")).cast("decimal(38,0)")
    )
    weight = F.pow(F.lit(2.0), top - (DIGIT_BITS * (first + 6 - 3)).cast("double"))
    return F.when(negative, -1.0).otherwise(1.0) * whole.cast("double") * weight


def box_stats(chart: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """high, low, median, mean, q1, q3 per recipe x dataset x metric.

    Every combination of a recipe, a dataset and a metric has a row, with
    nulls where there are no values. Quartiles interpolate linearly between
    order statistics (pandas' default); nulls and NaN are ignored. A mean is
    the exact sum, rounded once, over the count (exact while a group's
    magnitudes lie within a factor of 2 ** 200), so it does not depend on the
    order partial sums are combined in; with infinite values it is infinite,
    or NaN with both.

    The values are counted once (one row per combination and distinct value,
    partial counts before the shuffle); all the rest reads that table.
    """
    long = metrics_long(chart, metrics, latency=False)
    value = F.when(~F.isnan("value"), F.col("value"))
    counts = long.groupBy(F.struct("recipe", "dataset", "metric").alias("_k"), value.alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    known = counts.where(F.col("value").isNotNull())
    steps = [i / RANGES for i in range(1, RANGES)]
    largest = F.max(F.when(_finite(F.col("value")), F.abs("value")))
    totals = known.groupBy("_k").agg(
        F.max("value").alias("high"), F.min("value").alias("low"), F.sum("_c").alias("_n"),
        F.percentile_approx("value", steps, 4 * RANGES).alias("cuts"),
        F.greatest(F.coalesce(F.floor(F.log2(largest)).cast("double"), F.lit(0.0)) + 2, F.lit(-700.0)).alias("_top"),
    )
    rows = known.join(totals, "_k")
    sums = [_digit_sums(F.col("value"), F.col("_c"), F.col("_top")).alias("_digits"), *[F.first(c).alias(c) for c in ("_top", "_n", "high", "low")]]
    quart = _quartiles(rows, (0.25, 0.5, 0.75), sums)
    grid = _all_combinations(counts.select("_k.recipe", "_k.dataset"), metrics)
    up, down = F.col("high") == float("inf"), F.col("low") == float("-inf")
    mean = F.when(up & down, float("nan")).when(up, F.col("high")).when(down, F.col("low")).otherwise(_total(F.col("_digits"), F.col("_top")) / F.col("_n"))
    out = grid.join(quart.withColumn("mean", mean), "_k", "left")
    return out.select("_k.*", "high", "low", F.col("_q1").alias("median"), "mean", F.col("_q0").alias("q1"), F.col("_q2").alias("q3"))


def box_plot_table(stats: DataFrame) -> DataFrame:
    """Box-plot rows per dataset: recipes ordered case-insensitively
    ascending (``recipe_pos``), metrics descending (``metric_pos``).

    ``stats`` is the small aggregated table, so the two ranking windows run
    over a handful of rows per dataset.
    """
    rpos = F.dense_rank().over(Window.partitionBy("dataset").orderBy(F.lower("recipe"), "recipe"))
    mpos = F.dense_rank().over(Window.partitionBy("dataset").orderBy(F.col("metric").desc()))
    return stats.select(
        "dataset", "recipe", "metric",
        rpos.cast("long").alias("recipe_pos"), mpos.cast("long").alias("metric_pos"),
        "low", "q1", "median", "q3", "high", "mean",
    )


def _bin_index(value: Column, edges: Sequence[float]) -> Column:
    """NumPy ``histogram`` binning against explicit edges: bin i holds
    ``edges[i] <= v < edges[i+1]``; the last bin also holds its upper edge;
    values outside ``[edges[0], edges[-1]]`` get null. The edges are evenly
    spaced but for the last, so the bin is a quotient, put right by one where
    rounding missed the literal edge."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    last = len(edges) - 2
    guess = F.least(F.floor(value / F.lit(edges[1] - edges[0])), F.lit(last)).cast("int")
    low, high = F.get(arr, guess), F.get(arr, guess + 1)
    exact = F.when(value < low, guess - 1).when((value >= high) & (guess < last), guess + 1).otherwise(guess)
    return F.when((value >= edges[0]) & (value <= edges[-1]), exact)


def valid_measure(value: Column) -> Column:
    """Finite and non-negative."""
    return value.isNotNull() & ~F.isnan(value) & (value < float("inf")) & (value >= 0)


def histogram(chart: DataFrame, metrics: Sequence[str], latency: bool = True) -> DataFrame:
    """Dense histograms per dataset x recipe x metric: 10 score bins over
    [0, 1] for metrics, 50 latency bins; ``percent`` is within the facet.
    Every combination of a recipe, a dataset and a metric is a facet.

    One aggregation over the long frame, in which values outside the bins
    count under a null bin; facets and dense bins derive from its result.
    """
    long = metrics_long(chart, metrics, latency=latency)
    s_edges, l_edges = score_edges(), latency_edges()
    is_lat = F.col("metric") == "latency"
    v = F.col("value")
    slot = F.when(is_lat, _bin_index(v, l_edges)).otherwise(_bin_index(v, s_edges))
    counts = long.groupBy(
        F.struct("recipe", "dataset", "metric").alias("_k"), F.when(valid_measure(v), slot).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))

    facets = _all_combinations(counts.select("_k.recipe", "_k.dataset"), [*metrics, *(["latency"] if latency else [])])
    is_lat = F.col("_k.metric") == "latency"
    nbins = F.when(is_lat, F.lit(len(l_edges) - 1)).otherwise(F.lit(len(s_edges) - 1))
    grid = facets.select("_k", F.explode(F.sequence(F.lit(0), nbins - 1)).alias("bin"))
    dense = grid.join(counts, ["_k", "bin"], "left")
    edges = F.when(is_lat, F.array(*[F.lit(e) for e in l_edges])).otherwise(F.array(*[F.lit(e) for e in s_edges]))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    total = F.sum(n).over(Window.partitionBy("_k"))
    return dense.select(
        "_k.dataset", "_k.recipe", "_k.metric",
        F.col("bin").cast("long").alias("bin"),
        F.element_at(edges, F.col("bin") + 1).alias("lo"),
        F.element_at(edges, F.col("bin") + 2).alias("hi"),
        n.alias("n"),
        F.when(total > 0, n * 100.0 / total).alias("percent"),
    )


def status_counts(feedbacks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Feedback rows per status (works on batch and streaming frames)."""
    return feedbacks.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def latest_feedback(feedbacks: DataFrame) -> DataFrame:
    """(recipe, dataset, record_id, name, status): each feedback by its latest row, ties by the status."""
    order = F.struct(F.col("last_ts").isNotNull().alias("timed"), "last_ts", "status")
    return feedbacks.groupBy("recipe", "dataset", "record_id", "name").agg(F.max(order)["status"].alias("status"))


REPORTS = ("box-plots", "histogram-grid")


def compare_chart(chart: DataFrame, metrics: Sequence[str], output: str = "box-plots") -> DataFrame:
    """A report over all recipes and datasets of ``chart``: ``box-plots``
    gives the box-plot table, ``histogram-grid`` the score and latency
    histograms; any other name raises."""
    if output not in REPORTS:
        raise ValueError(f"no report is called {output!r}; there are {', '.join(REPORTS)}")
    if output == "box-plots":
        return box_plot_table(box_stats(chart, metrics))
    return histogram(chart, metrics, latency=True)


def compare(store: RunStore, recipes: Sequence[str] | None = None, output: str = "box-plots") -> DataFrame:
    """The report ``output`` over what ``store`` holds of the given recipes
    (default: all), all datasets and the metrics found there."""
    feedbacks = store.feedbacks()
    metrics = list_metrics(feedbacks, recipes)
    return compare_chart(chart_data(store.records(), feedbacks, recipes, metrics=metrics), metrics, output)
