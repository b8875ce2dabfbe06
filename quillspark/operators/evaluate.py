"""Comparing regimes: overlap of what they retrieve, paired tests, intervals, pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.constants import T_BEYOND, T_POINTS
from quillspark.operators.ordered import place_in_group, quantiles


def work_list(questions: DataFrame, regimes: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(question_id, regime) still to run. Both sides are small lists of the experiment's own."""
    grid = questions.select("question_id").crossJoin(regimes.select("regime"))
    return grid if done is None else grid.join(done.select("question_id", "regime"), ["question_id", "regime"], "left_anti")


def overlap(runs: DataFrame) -> DataFrame:
    """Mean Jaccard overlap of retrieved units for each ordered pair of regimes.

    runs: (question_id, regime, unit_id). Averaged over the first regime's questions where either side
    has units; 0 if there are none. Shared units come from an equi-join on (question, unit)."""
    sets = runs.select("question_id", "regime", "unit_id").distinct()
    sizes = sets.groupBy("question_id", "regime").agg(F.count("*").alias("n"))
    b = sets.withColumnRenamed("regime", "regime_b")
    shared = sets.withColumnRenamed("regime", "regime_a").join(b, ["question_id", "unit_id"]).groupBy("question_id", "regime_a", "regime_b").agg(F.count("*").alias("both"))
    names = sizes.select(F.col("regime").alias("regime_b")).distinct()
    left = sizes.select("question_id", F.col("regime").alias("regime_a"), F.col("n").alias("n_a")).crossJoin(F.broadcast(names))  # regimes are a handful
    right = sizes.select("question_id", F.col("regime").alias("regime_b"), F.col("n").alias("n_b"))
    pairs = left.join(right, ["question_id", "regime_b"], "left").join(shared, ["question_id", "regime_a", "regime_b"], "left").fillna(0, ["n_b", "both"])
    share = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return pairs.groupBy("regime_a", "regime_b").agg(F.bround(F.avg(share), 3).alias("jaccard"))


def t_critical(df: F.Column) -> F.Column:
    """The point of the first tabled degrees of freedom at or above df; NaN for none."""
    out = F.lit(T_BEYOND)
    for k in sorted(T_POINTS, reverse=True):
        out = F.when(df <= k, T_POINTS[k]).otherwise(out)
    return F.when(df > 0, out).otherwise(float("nan"))


def paired_tests(scores: DataFrame, baseline: str, metric: str = "score") -> DataFrame:
    """Per regime against the baseline on shared questions: n, mean difference, t, df, significance.

    scores: one row per (question_id, regime). Fewer than two pairs give NaN; no spread gives an
    infinite t unless the mean is zero. A score is read once for both sides of its differences, as means summed
    in another order are not quite equal: the baseline differs from itself by nothing."""
    known = scores.where(F.col(metric).isNotNull() & F.col("question_id").isNotNull())
    base = F.max(F.when(F.col("regime") == baseline, F.col(metric))).over(Window.partitionBy("question_id"))  # a row a regime
    pairs = known.select("regime", (F.col(metric) - base).alias("d")).where(F.col("d").isNotNull())
    sums = pairs.groupBy("regime").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    every = scores.select("regime").distinct().join(sums, "regime", "left").fillna(0, ["n"])
    t = F.when(F.col("n") < 2, float("nan")).when(F.col("sd") == 0, F.when(F.col("mean") == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide("mean", F.col("sd") / F.sqrt("n")))
    out = every.withColumn("t", t).withColumn("df", F.greatest(F.col("n") - 1, F.lit(0)))
    sure = F.when(F.col("n") < 2, False).when(F.col("sd") == 0, F.col("mean") != 0).otherwise(F.abs("t") > t_critical(F.col("df")))
    return out.select("regime", "n", F.when(F.col("n") >= 2, F.col("mean")).otherwise(float("nan")).alias("mean_diff"), "t", "df", sure.alias("significant"))


#: How often a resample takes a value is a Poisson number of mean 1: more than k times if its draw,
#: evenly spread below 2^32, is at or above the k-th of these (the distribution's sums, k = 0 to 11).
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12))
ROUND_STEP, MIXER = 2654435769, 0x45D9F3B


def mixed(x: np.ndarray) -> np.ndarray:
    """An integer hash below 2^32 of integers below 2^32, in 64-bit arithmetic that any engine repeats."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIXER & 0xFFFFFFFF
    return (x >> 16) ^ x


def bootstrap_intervals(values: DataFrame, groups: tuple[str, ...] = (), value: str = "score", rounds: int = 4000, seed: int = 1, key: str | None = None) -> DataFrame:
    """(groups, low, high): the 2.5 and 97.5 percent places among the means of resamples, one row a group; NaN for
    under two values. Null values do not count.

    How often round r takes a row is told by a hash of (row's key, round), so a row is drawn where it lies: tasks
    hand on two sums a group and round, whatever the number of rows. key: a column that tells a group's rows
    apart (rows of one key are drawn together); without one, values are numbered among their equals. Rounds
    that draw nothing have no mean; places are taken among the others."""
    given = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("__v"), *([F.col(key).cast("string").alias("__k")] if key else []))
    if not key:
        bits = F.hex(F.col("__v").cast("string").cast("binary"))
        # Which of its equals a value is counted as makes no difference; the tie only lets ranges part them.
        given = place_in_group(given.withColumn("__tie", F.monotonically_increasing_id()), (*groups, "__v"), "__tie").select(*groups, "__v", F.concat_ws(":", bits, F.col("n").cast("string")).alias("__k"))
    number = F.conv(F.substring(F.md5(F.col("__k").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = given.select(*groups, "__v", F.pmod(number + seed, F.lit(2**32)).alias("__key"))
    names = [f"g{i}" for i in range(len(groups))]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{n} {kinds[g]}" for n, g in zip(names, groups, strict=True)), "round int, total double, weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        steps = np.arange(rounds, dtype=np.int64) * ROUND_STEP & 0xFFFFFFFF
        for batch in batches:
            keys = mixed(batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64))
            drawn = batch.column("__v").to_numpy(zero_copy_only=False)
            for i, group in enumerate(zip(*(batch.column(g).to_pylist() for g in groups), strict=True) if groups else [()] * batch.num_rows):
                total, weight = sums.setdefault(group, (np.zeros(rounds), np.zeros(rounds, np.int64)))
                times = np.searchsorted(POISSON, mixed((keys[i] + steps) & 0xFFFFFFFF), side="right")
                total += times * drawn[i]
                weight += times
        for group, (total, weight) in sums.items():
            columns = [pa.array([v] * rounds, batch.schema.field(g).type) for v, g in zip(group, groups, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(rounds, dtype=np.int32)), pa.array(total), pa.array(weight)], names=[*names, "round", "total", "weight"])

    added = rows.mapInArrow(run, schema).groupBy(*names, "round").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    means = added.where("weight > 0").select(*names, "round", (F.col("total") / F.col("weight")).alias("m"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy("m", "round")) - 1  # at most `rounds` rows a group
    of = F.count("*").over(Window.partitionBy(*names))
    ranked = means.select(*names, "m", place.alias("place"), of.alias("of"))
    ends = {name: F.min(F.when(F.col("place") == F.floor(F.col("of") * share), F.col("m"))).alias(name) for name, share in (("low", 0.025), ("high", 0.975))}
    found = ranked.groupBy(*names).agg(*ends.values())
    sizes = given.groupBy(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True))).agg(F.count("*").alias("n"))
    on = [F.lit(True)] if not groups else [sizes[n].eqNullSafe(found[n]) for n in names]
    both = sizes.join(found, on, "left")  # a row a group
    nan = F.lit(float("nan"))
    return both.select(*(sizes[n].alias(g) for n, g in zip(names, groups, strict=True)), *(F.when(F.col("n") < 2, nan).otherwise(F.coalesce(c, nan)).alias(c) for c in ("low", "high")))


def bootstrap_interval(values: DataFrame, value: str = "score", rounds: int = 4000, seed: int = 1, key: str | None = None) -> DataFrame:
    """(low, high) of all values."""
    return bootstrap_intervals(values, (), value, rounds, seed, key)


def group_pivot(scores: DataFrame, regimes: list[str], metric: str = "score") -> DataFrame:
    """Mean per question group (first character of the id) and regime."""
    return scores.withColumn("grp", F.substring("question_id", 1, 1)).groupBy("grp").pivot("regime", regimes).agg(F.avg(metric))


def regime_summary(runs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Runs, rated runs, averages, and the average of blind ratings per regime."""
    joined = runs.join(ratings, "run_id", "left")
    return joined.groupBy("regime").agg(
        F.count("*").alias("runs"),
        F.count("overall").alias("rated"),
        *(F.avg(c).alias(f"avg_{c}") for c in ("overall", "correctness", "completeness", "grounding")),
        F.avg(F.when(F.col("blind"), F.col("overall"))).alias("avg_blind"),
    )


def blind_split(ratings: DataFrame, runs: DataFrame) -> DataFrame:
    """Blind and open ratings per regime, where correctness was given."""
    given = ratings.where(F.col("correctness").isNotNull()).join(runs.select("run_id", "regime"), "run_id")
    return given.groupBy("regime").agg(F.sum(F.when(F.col("blind"), 1).otherwise(0)).cast("long").alias("blind"), F.sum(F.when(F.col("blind"), 0).otherwise(1)).cast("long").alias("open"))


def retrieval_means(metrics: DataFrame) -> DataFrame:
    """Mean of each retrieval figure per regime."""
    figures = [c for c, t in metrics.dtypes if c not in ("regime", "question_id", "query_id") and t in ("int", "bigint", "double")]
    return metrics.groupBy("regime").agg(*(F.avg(c).alias(f"mean_{c}") for c in figures))


def volume_bands(metrics: DataFrame, column: str = "n_fragments") -> DataFrame:
    """few (15 or less), medium, or many (100 or more) fragments."""
    band = F.when(F.col(column) <= 15, "few").when(F.col(column) >= 100, "many").otherwise("medium")
    return metrics.withColumn("band", band)


def question_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("grp").agg(F.countDistinct("question_id").alias("questions"))


def choose_questions(questions: DataFrame, groups: tuple[str, ...] = (), ids: tuple[str, ...] = ()) -> DataFrame:
    out = questions.where(F.upper("grp").isin(*(g.upper() for g in groups))) if groups else questions
    return out.where(F.col("question_id").isin(*ids)) if ids else out


def next_unrated(runs: DataFrame, ratings: DataFrame) -> DataFrame:
    """The least question with an unrated run."""
    return runs.join(ratings.select("run_id"), "run_id", "left_anti").agg(F.min("question_id").alias("question_id"))


def rating_queue(runs: DataFrame, ratings: DataFrame, question_id: str, seed: int = 1) -> DataFrame:
    """The runs of a question with their ratings, in a seeded random order."""
    mine = runs.where(F.col("question_id") == question_id).join(ratings, "run_id", "left")
    return mine.orderBy(F.xxhash64("run_id", F.lit(seed)), "run_id")


def regime_table(scores: DataFrame, baseline: str, metric: str = "score", rounds: int = 4000) -> DataFrame:
    """Per regime, over the questions it shares with the baseline: n, mean and its interval, mean difference, t,
    df, significance. Questions are the rows that resamples draw."""
    base = scores.where((F.col("regime") == baseline) & F.col(metric).isNotNull()).select("question_id").distinct()
    shared = scores.where(F.col(metric).isNotNull()).join(base, "question_id", "left_semi")
    means = shared.groupBy("regime").agg(F.avg(metric).alias("mean"))
    intervals = bootstrap_intervals(shared, ("regime",), metric, rounds, key="question_id")
    return paired_tests(scores, baseline, metric).join(means, "regime", "left").join(intervals, "regime", "left")


def box_plots(scores: DataFrame, metric: str = "score") -> DataFrame:
    """Per regime what a box plot shows: least, quartiles (interpolated), greatest, and the number of scores."""
    return quantiles(scores, "regime", metric, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def report(runs: DataFrame, ratings: DataFrame, baseline: str, metrics: tuple[str, ...] = ("overall", "correctness", "completeness", "grounding"), rounds: int = 4000) -> dict[str, DataFrame]:
    """The whole report by name: retrieval means (where runs carry figures), a table of regimes for each
    metric, the group pivot, and the blind split. Refuses without runs or ratings."""
    if runs.isEmpty():
        raise ValueError("no runs stored")
    if ratings.where(F.col(metrics[0]).isNotNull()).isEmpty():
        raise ValueError("no ratings stored")
    rated = runs.select("run_id", "question_id", "regime").join(ratings, "run_id")
    scores = {m: rated.groupBy("question_id", "regime").agg(F.avg(m).alias("score")) for m in metrics}
    regimes = sorted(r[0] for r in runs.select("regime").distinct().collect())
    out = {f"table_{m}": regime_table(s, baseline, rounds=rounds) for m, s in scores.items()}
    figures = runs.drop("run_id", "question_id", "regime").columns
    out |= {"retrieval": retrieval_means(runs.drop("run_id"))} if figures else {}
    return out | {"groups": group_pivot(scores[metrics[0]], regimes), "blind": blind_split(ratings, runs)}
