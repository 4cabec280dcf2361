"""Evaluation of coded rows.

Input of most functions is an evaluation table (R10):
``true_code, pred_code, confidence, retrieved_codes`` plus any id columns.
Every metric here is one aggregation pass (partial aggregation on the map
side, a single-row or few-row final stage), except exact quantiles, which use
a distributed sort instead of holding a group in one buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The thresholds of the precision-coverage curve are i/10, i = 1..9.
THRESHOLDS = tuple(i / 10 for i in range(1, 10))


def evaluation_columns(ev: DataFrame, truth: str = "true_code", pred: str = "pred_code",
                       candidates: str = "retrieved_codes") -> DataFrame:
    """P14 hit, P15 correct (null prediction is wrong), P16 correct-given-hit."""
    hit = F.coalesce(F.array_contains(F.col(candidates), F.col(truth)), F.lit(False))
    correct = F.coalesce(F.col(pred) == F.col(truth), F.lit(False))
    return (ev.withColumn("retriever_hit", hit)
            .withColumn("correct", correct)
            .withColumn("correct_given_hit", F.when(F.col("retriever_hit"), F.col("correct"))))


def _ratio(num: Column, den: Column) -> Column:
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), 6)


def rag_metrics(ev: DataFrame) -> DataFrame:
    """A4-A9 as one long table ``(metric, value)``; one aggregation pass.

    Conditional accuracy over zero hits is null (not NaN). ``identity_gap`` is
    pipeline accuracy minus retriever@k x conditional accuracy; it is zero
    exactly when no correct prediction lies outside the candidate list, which
    ``correct_not_retrieved`` counts.
    """
    hit, correct = F.col("retriever_hit"), F.col("correct")
    agg = ev.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(hit).alias("n_hit"),
        F.count_if(correct).alias("n_correct"),
        F.count_if(~hit).alias("n_retriever_errors"),
        F.count_if(hit & ~correct).alias("n_generation_errors"),
        F.count_if(correct & ~hit).alias("correct_not_retrieved"),
    )
    m = agg.select(
        "*",
        _ratio(F.col("n_hit"), F.col("n_total")).alias("retriever_at_k"),
        _ratio(F.col("n_correct"), F.col("n_hit")).alias("conditional_accuracy_raw"),
        _ratio(F.col("n_correct"), F.col("n_total")).alias("pipeline_accuracy"),
    )
    # Conditional accuracy counts only correct rows that were hits.
    m = m.withColumn("conditional_accuracy",
                     _ratio(F.col("n_correct") - F.col("correct_not_retrieved"), F.col("n_hit")))
    m = m.withColumn("retriever_x_conditional",
                     F.round(F.col("retriever_at_k") * F.col("conditional_accuracy"), 6))
    m = m.withColumn("identity_gap",
                     F.round(F.col("pipeline_accuracy") - F.col("retriever_x_conditional"), 6))
    m = m.withColumn("retriever_error_share", _ratio(F.col("n_retriever_errors"), F.col("n_total")))
    m = m.withColumn("generation_error_share",
                     _ratio(F.col("n_generation_errors"), F.col("n_total")))
    names = ["n_total", "n_hit", "n_correct", "n_retriever_errors", "n_generation_errors",
             "correct_not_retrieved", "retriever_at_k", "conditional_accuracy",
             "pipeline_accuracy", "retriever_x_conditional", "identity_gap",
             "retriever_error_share", "generation_error_share"]
    m = m.select(*[F.col(n).cast("double").alias(n) for n in names])
    return m.unpivot([], names, "metric", "value")


def error_split(ev: DataFrame) -> DataFrame:
    """``(stage, n, share)`` for retriever errors, generation errors, correct, total."""
    hit, correct = F.col("retriever_hit"), F.col("correct")
    agg = ev.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(~hit).alias("retriever_error"),
                 F.count_if(hit & ~correct).alias("generation_error"),
                 F.count_if(correct).alias("correct"))
    long = agg.unpivot(["total"], ["retriever_error", "generation_error", "correct"], "stage", "n")
    return long.select("stage", "n", _ratio(F.col("n"), F.col("total")).alias("share"))


def precision_coverage(ev: DataFrame, thresholds=THRESHOLDS, conf: str = "confidence"
                       ) -> DataFrame:
    """Long ``(threshold, metric, value)``; thresholds keeping no row emit nothing.

    One pass: two conditional aggregates per threshold, then ``inline``.
    """
    c, ok = F.col(conf), F.col("correct")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(thresholds):
        aggs.append(F.count_if(c >= F.lit(t)).alias(f"_k{i}"))
        aggs.append(F.count_if((c >= F.lit(t)) & ok).alias(f"_c{i}"))
    a = ev.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).cast("double").alias("threshold"),
                              F.col(f"_k{i}").alias("kept"), F.col(f"_c{i}").alias("good"))
                     for i, t in enumerate(thresholds)])
    per_t = (a.select("_n", F.inline(rows)).where(F.col("kept") > 0)
             .select("threshold", _ratio(F.col("good"), F.col("kept")).alias("precision"),
                     _ratio(F.col("kept"), F.col("_n")).alias("coverage")))
    return per_t.unpivot(["threshold"], ["precision", "coverage"], "metric", "value")


def threshold_for_precision(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """Lowest threshold whose precision reaches ``target``, with its coverage."""
    wide = (curve.groupBy("threshold")
            .agg(F.max(F.when(F.col("metric") == "precision", F.col("value"))).alias("precision"),
                 F.max(F.when(F.col("metric") == "coverage", F.col("value"))).alias("coverage")))
    ok = wide.where(F.col("precision") >= F.lit(target))
    return ok.agg(F.lit(target).cast("double").alias("target"),
                  F.min("threshold").alias("threshold"),
                  F.min_by("coverage", "threshold").alias("coverage"))


def exact_quantiles(df: DataFrame, group: str, value: str, probs) -> DataFrame:
    """Exact linear-interpolated quantiles per group (same as ``percentile`` /
    ``quantile_cont``) without gathering a group in one aggregation buffer.

    The values are range-partitioned and sorted (a distributed sort); each
    row's position inside its group comes from per-partition counts, a table
    of (#partitions x #groups) rows; only the rows at the needed positions are
    kept and interpolated. Output: ``group, p, q``.
    """
    d = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull())
    s = (d.repartitionByRange("_g", "_v").sortWithinPartitions("_g", "_v")
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id()
                     - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    s = s.checkpoint()  # lineage cut in the shared checkpoint folder: positions stay stable
    blocks = s.groupBy("_g", "_pid").agg(F.min("_local").alias("_lo"),
                                         F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy("_g").orderBy("_pid")
    blocks = (blocks.withColumn("_before", F.coalesce(
        F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_n", F.sum("_cnt").over(Window.partitionBy("_g"))))
    # blocks / targets grow with the number of groups: no broadcast hint; AQE
    # turns the join into a broadcast at run time when they are small.
    pos = (s.join(blocks, ["_g", "_pid"])
           .select("_g", "_v", "_n", (F.col("_before") + F.col("_local") - F.col("_lo"))
                   .alias("_pos")))
    targets = (blocks.select("_g", "_n").distinct()
               .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .withColumn("_h", (F.col("_n") - 1) * F.col("p"))
               .withColumn("_at", F.explode(F.array_distinct(F.array(
                   F.floor("_h").cast("long"), F.ceil("_h").cast("long"))))))
    picked = pos.join(targets, ["_g", "_n"]).where(F.col("_pos") == F.col("_at"))
    q = (picked.groupBy("_g", "p")
         .agg(F.first("_h").alias("_h"),
              F.min_by("_v", "_pos").alias("_vlo"), F.max_by("_v", "_pos").alias("_vhi"))
         .select(F.col("_g").alias(group), "p",
                 (F.col("_vlo") + (F.col("_h") - F.floor("_h")) * (F.col("_vhi") - F.col("_vlo")))
                 .alias("q")))
    return q


def confidence_box(ev: DataFrame, conf: str = "confidence") -> DataFrame:
    """Boxplot statistics of confidence for correct vs incorrect rows.

    ``outcome, n, q1, median, q3, lower_whisker, upper_whisker, n_outliers``;
    whiskers are the extreme values inside 1.5 IQR of the quartiles.
    """
    lab = ev.select(F.when(F.col("correct"), "Correct").otherwise("Incorrect").alias("outcome"),
                    F.col(conf).cast("double").alias("_c"))
    qs = exact_quantiles(lab, "outcome", "_c", (0.25, 0.5, 0.75))
    wide = qs.groupBy("outcome").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    wide = (wide.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
            .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    inside = (F.col("_c") >= F.col("_lo")) & (F.col("_c") <= F.col("_hi"))
    j = lab.join(F.broadcast(wide), "outcome")  # two rows: one per outcome
    out = j.groupBy("outcome", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_c"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_c"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"))
    return out.select("outcome", "n", *[F.round(c, 6).alias(c) for c in
                                        ("q1", "median", "q3", "lower_whisker", "upper_whisker")],
                      "n_outliers")


def value_counts(df: DataFrame, col: str, n: int | None = 10) -> DataFrame:
    """A3: count per value, most frequent first, ties by value; top ``n``."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.col("count").desc(), F.col(col).asc_nulls_first())
    return out.limit(n) if n else out


def n_unique(df: DataFrame, col: str) -> DataFrame:
    """A1 + A2: rows and distinct values; a null counts as one value, as in the reference."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  (F.count_distinct(F.col(col))
                   + F.coalesce(F.max(F.col(col).isNull().cast("int")), F.lit(0))).alias("n_unique"))


def accuracy(pred: DataFrame, truth: DataFrame, on: str, pred_col: str, truth_col: str
             ) -> DataFrame:
    """A10 + J4: align predictions with truth on an id (sizes must agree), mean(pred = truth)."""
    j = pred.select(on, pred_col).join(truth.select(on, truth_col), on, "full")
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(pred_col).isNull() | F.col(truth_col).isNull()).alias("n_unaligned"),
        F.count_if(F.col(pred_col) == F.col(truth_col)).alias("n_correct"),
    ).select("n", "n_unaligned", "n_correct",
             _ratio(F.col("n_correct"), F.col("n")).alias("accuracy"))
