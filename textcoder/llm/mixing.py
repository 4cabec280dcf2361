"""Mixing sources to target weights by Pareto order sampling.

A source of ``S`` words with target ``T`` first gives ``floor(T / S)`` certain whole copies of each of
its documents. The rest of the target, ``R`` words, is a sample without replacement of unequal probabilities: document i has
inclusion probability ``p_i = min(1, c w_i)``, with c such that the sample has R words on average (``w_i``: by default
``ln(1 + size)``, so that longer documents are likelier), a reproducible uniform ``u_i``, and the rank
``[u_i / (1 - u_i)] / [p_i / (1 - p_i)]``. The size is fixed in words, not in documents: documents
are taken in order of rank up to the first that does not fit into what is missing. What is missing then, less than that one, is
filled by the largest documents left that fit, until none does, and closed by the one further document whose size comes nearest, if that helps.

The cut of a source is found without sorting the source: sums over fine bins of the rank give the
bin in which the target is met, and only that bin (about 1/4000 of a source) is ordered exactly. The filling goes in rounds over the
``_ROUND`` largest documents of each source that fit. Only tables with a row per source, bin or document of a round are shuffled, and a hot
source is summed map-side.

Defined cases: a null source is a source of its own, the last; a null text has no words; a source
without words has target 0; rows with equal key share rank and fate, so reruns agree; a weight that is null or negative
counts as 0, and such documents are not sampled; an empty table gives an empty result; columns named like the outputs are replaced, and other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcoder.llm.util import cut, cut_few, lookup, unit_interval, word_count

SEED = 8
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
_BINS_PER_E = 1024
#: Documents of a source that a round past the cut looks at.
_ROUND = 64


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``target`` of each row (source, source_size): weight shares of all words, capped at ``max_copies`` sizes.

    What a capped source leaves is shared again by weight. With the sources in order of
    cap / weight, the level of the first uncapped one solves this in closed form. The input has
    one row per source.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    t = (sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(by_code) - 1) % len(weights)).cast("int")))
         .withColumn("cap", F.col("source_size") * max_copies)
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest, everything = by_cap.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    t = (t.withColumn("level", (F.sum("source_size").over(everything)
                                - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)),
                                             F.lit(0))) / F.sum("weight").over(rest))
         .withColumn("at", F.row_number().over(by_cap)))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything)["level"]
    return (t.withColumn("first", F.coalesce(first, F.lit(0.0)))
            .select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("weight") * F.col("first")).alias("target")))


def _inclusion(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """``scale`` of each source with sum(min(1, scale * weight) * size) = its remaining words.

    The documents of the largest weights reach 1 first. In order of falling weight, a further document is certain as long as the scale that
    the others then have lifts it to 1; whether all of a bin of weights are certain shows in the bin's sums and its least
    weight alone. So one aggregation finds the bin in which that ends, and only this bin's weights are looked at one by one.
    """
    some = rows.filter((F.col("weight") > 0) & (F.col("size") > 0)).withColumn("w_bin", F.floor(F.log("weight") * _BINS_PER_E))
    words, mass = F.sum("size"), F.sum(F.col("weight") * F.col("size"))
    bins = some.groupBy("source", "w_bin").agg(words.alias("words"), mass.alias("mass"), F.min("weight").alias("least"))
    down = Window.partitionBy("source").orderBy(F.col("w_bin").desc())
    above, through = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, 0)
    below = down.rowsBetween(1, Window.unboundedFollowing)
    bins = (bins.withColumn("taken", F.coalesce(F.sum("words").over(above), F.lit(0))).withColumn("then", F.sum("words").over(through))
            .withColumn("rest", F.sum("mass").over(below)).join(quota, F.col("source").eqNullSafe(F.col("q_source"))))
    all_certain = F.coalesce((F.col("remaining") - F.col("then")) / F.col("rest") * F.col("least") >= 1, F.lit(False))
    ends = (bins.filter(~all_certain).groupBy("q_source", "remaining")
            .agg(F.max(F.struct("w_bin", "taken", F.coalesce("rest", F.lit(0.0)).alias("rest"))).alias("end")))
    ends = lookup(ends.select(F.col("q_source").alias("e_source"), "remaining", "end.*").withColumnRenamed("w_bin", "end_bin"), few=True)
    each = (some.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("w_bin") == F.col("end_bin")))
            .groupBy("e_source", "remaining", "taken", "rest", "weight").agg(words.alias("words"), mass.alias("mass")))
    by_weight = Window.partitionBy("e_source").orderBy(F.col("weight").desc())
    before = F.coalesce(F.sum("words").over(by_weight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("rest") + F.sum("mass").over(by_weight.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("scale", (F.col("remaining") - F.col("taken") - before) / left).filter(F.col("scale") * F.col("weight") < 1)
    found = each.groupBy("e_source").agg(F.max_by("scale", "weight").alias("scale"))
    # Without a weight where it ends, all documents are certain.
    none = F.when(F.col("remaining") > 0, F.lit(float("inf"))).otherwise(0.0)
    return (quota.join(found, F.col("q_source").eqNullSafe(F.col("e_source")), "left")
            .select("q_source", "whole", "remaining", F.coalesce("scale", none).alias("scale")))


def size_weight(size: Column) -> Column:
    """Weight of a document of so many words in the sample of its source."""
    return F.log(1 + size.cast("double"))


def _cuts(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, cut_bin, last, got): where the rows of each source, in order of (q, key), pass its ``missing`` words.

    ``rows``: source, q, bin, key, size; ``budget``: source, missing. ``got`` words are in the rows up to ``last`` (q, key; null: in none of
    the cut bin). A source whose rows do not pass what is missing has no cut (null bin) and all its words.
    """
    small = budget.select(F.col("source").alias("b_source"), "missing")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .join(small, F.col("source").eqNullSafe(F.col("b_source"))).drop("b_source"))
    # The first bin in which the words pass what is missing.
    found = cut_few(bins.groupBy("source", "missing").agg(
        F.min(F.when(F.col("before") + F.col("words") > F.col("missing"), F.struct("bin", "before"))).alias("at"), F.sum("words").alias("words")))
    inside = lookup(found.filter("at is not null").select(F.col("source").alias("c_source"), F.col("at.bin").alias("c_bin"),
                                                          F.col("at.before").alias("before"), "missing"), few=True)
    run = Window.partitionBy("c_source").orderBy("q", "key").rowsBetween(Window.unboundedPreceding, 0)
    last = (rows.join(inside, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bin") == F.col("c_bin")))
            .withColumn("upto", F.col("before") + F.sum("size").over(run)).filter(F.col("upto") <= F.col("missing"))
            .groupBy(F.col("c_source").alias("l_source")).agg(F.max(F.struct("q", "key")).alias("last"), F.max("upto").alias("upto")))
    return (found.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
            .select("source", F.col("at.bin").alias("cut_bin"), "last", F.coalesce("upto", "at.before", "words").alias("got")))


def _before(row_bin: Column, row: Column) -> Column:
    """Whether a row (q, key) lies before the cut of its source."""
    return F.coalesce(F.col("cut_bin").isNull() | (row_bin < F.col("cut_bin")) | ((row_bin == F.col("cut_bin")) & (row <= F.col("last"))),
                      F.lit(False))


def _fill(ranked: DataFrame, budget: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, further): the cut of each source, and the (source, key) that are taken past it."""
    cuts = lookup(_cuts(ranked, budget), few=True)
    at = lookup(budget.select(F.col("source").alias("of"), "missing").join(cuts.withColumnRenamed("source", "c"), F.col("of").eqNullSafe(F.col("c")), "left")
                .select("of", (F.col("missing") - F.coalesce("got", F.lit(0))).alias("left"), "cut_bin", "last"), few=True)
    beyond = cut(ranked.join(at, F.col("source").eqNullSafe(F.col("of"))).filter(~_before(F.col("bin"), F.struct("q", "key")))
                 .select("source", "size", "q", "key"))
    order = F.struct((-F.col("size")).alias("size"), "q", "key")
    first = Window.partitionBy("source").orderBy(F.col("size").desc(), "q", "key")
    # Of each source: what is missing, the document up to which all were looked at (largest first), and those taken by the last round.
    state = at.select("of", "left", F.lit(None).cast(beyond.select(order.alias("o")).schema["o"].dataType).alias("seen"))
    further = beyond.select("source", "key").limit(0)
    while True:
        small = lookup(state.select("of", "left", "seen"), few=True)
        fitting = (beyond.join(small, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("size") <= F.col("left")) & F.coalesce(order > F.col("seen"), F.lit(True)))
                   .withColumn("no", F.row_number().over(first)).filter(F.col("no") <= _ROUND))
        # At most _ROUND documents a source; each is taken if it fits into what those before it leave.
        took = fitting.groupBy("source").agg(F.max("left").alias("left"), F.array_sort(F.collect_list(order)).alias("rows"))
        start = F.struct(F.col("left").alias("left"), F.filter("rows", lambda _: F.lit(False)).alias("taken"))
        end = F.aggregate("rows", start, lambda a, x: F.when(-x["size"] <= a["left"], F.struct(
            (a["left"] + x["size"]).alias("left"), F.array_append(a["taken"], x).alias("taken"))).otherwise(a))
        state = cut_few(took.select(F.col("source").alias("of"), F.element_at("rows", -1).alias("seen"), end.alias("end"))
                        .select("of", "end.left", "seen", "end.taken"))
        if state.isEmpty():
            break
        further = cut_few(further.union(state.select(F.col("of").alias("source"), F.explode("taken.key").alias("key"))))
    # One further document, if it brings the words nearer to the target.
    gone = lookup(further.select(F.col("source").alias("g"), F.col("key").alias("g_key")), few=True)
    rest = (beyond.join(gone, F.col("source").eqNullSafe(F.col("g")) & F.col("key").eqNullSafe(F.col("g_key")), "left"))
    got = rest.filter("g_key is not null or g is not null").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("more"))
    left = lookup(at.select("of", "left").join(got, F.col("of").eqNullSafe(F.col("s")), "left")
                  .select("of", (F.col("left") - F.coalesce("more", F.lit(0))).alias("left")), few=True)
    off = F.abs(F.col("left") - F.col("size"))
    closing = (rest.filter("g_key is null and g is null").join(left, F.col("source").eqNullSafe(F.col("of"))).filter(off < F.col("left"))
               .groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "key")).alias("x")).select("source", F.col("x.key").alias("key")))
    return cuts, lookup(further.union(closing), few=True)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, doc_weight: str | None = None,
        seed: int = SEED) -> DataFrame:
    """All columns of ``df`` and: size, source_size, target, copies (0 to ``max_copies``).

    ``doc_weight`` names a column of weights; without, a document weighs by its size (``size_weight``).
    """
    outputs = ("size", "source_size", "target", "copies")
    names = df.columns
    inner = {n: f"in_{i}" for i, n in enumerate(names)}
    size = word_count(F.col(inner[text]))
    given = size_weight(size) if doc_weight is None else F.col(inner[doc_weight]).cast("double")
    weight = F.greatest(F.coalesce(given, F.lit(0.0)), F.lit(0.0))
    u = unit_interval(F.lit(seed), F.col(inner[key]))
    whole = df.toDF(*inner.values())
    slim = cut(whole.select(F.col(inner[key]).alias("key"), F.col(inner[source]).alias("source"), size.alias("size"), weight.alias("weight"), u.alias("u")))
    goal = cut_few(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    quota = (goal.withColumn("whole", F.least(F.floor(times), F.lit(max_copies)).cast("int"))
             .select(F.col("source").alias("q_source"), "whole",
                     F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")).alias("remaining")))
    quota = lookup(_inclusion(slim, quota), few=True)

    def ranked(rows: DataFrame, src: str, w: Column, draw: Column) -> DataFrame:
        """Adds p, q and bin; a certain document (p = 1) and one that is not sampled (p = 0) have no rank."""
        at = rows.join(quota, F.col(src).eqNullSafe(quota["q_source"]), "left")
        p = F.when(w > 0, F.least(F.lit(1.0), F.col("scale") * w)).otherwise(0.0)
        q = (draw / (1 - draw)) / (p / (1 - p))
        return (at.withColumn("p", p).withColumn("q", F.when((p > 0) & (p < 1), q))
                .withColumn("bin", F.floor(F.log("q") * _BINS_PER_E)))

    at = cut(ranked(slim, "source", F.col("weight"), F.col("u")).select("source", "key", "size", "p", "q", "bin"))
    sure = at.groupBy(F.col("source").alias("s")).agg(F.sum(F.when(F.col("p") >= 1, F.col("size")).otherwise(0)).alias("certain"))
    budget = cut_few(quota.join(sure, F.col("q_source").eqNullSafe(F.col("s")))
                     .select(F.col("q_source").alias("source"), (F.col("remaining") - F.col("certain")).alias("missing")))
    rows = cut(at.filter("q is not null and size > 0").groupBy("source", "q", "bin", "key").agg(F.sum("size").alias("size")))
    cuts, further = _fill(rows, budget)
    marks = lookup(goal.select(F.col("source").alias("m_source"), "source_size", "target")
                   .join(cuts.withColumn("has_cut", F.lit(True)), F.col("m_source").eqNullSafe(F.col("source")), "left").drop("source"), few=True)
    further = further.select(F.col("source").alias("f_source"), F.col("key").alias("f_key"), F.lit(True).alias("picked")).distinct()
    own = whole.select("*", size.alias("size"), weight.alias("weight"), u.alias("u"))
    own = (ranked(own, inner[source], F.col("weight"), F.col("u"))
           .join(marks, F.col(inner[source]).eqNullSafe(F.col("m_source")), "left")
           .join(further, F.col(inner[source]).eqNullSafe(F.col("f_source")) & F.col(inner[key]).eqNullSafe(F.col("f_key"))
                 & F.col("q").isNotNull() & (F.col("size") > 0), "left"))
    first = F.coalesce(F.col("has_cut"), F.lit(False)) & F.col("q").isNotNull() & _before(F.col("bin"), F.struct("q", F.col(inner[key]).alias("key")))
    own = own.withColumn("copies", F.col("whole") + ((F.col("p") >= 1) | first | F.col("picked").isNotNull()).cast("int"))
    return own.select(*[F.col(inner[n]).alias(n) for n in names if n not in outputs], *outputs)


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document repeated by its copies, with the columns of ``df`` only."""
    names = df.columns
    slim = mix(df.select("*", *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(names)]), **options)
    again = slim.filter("copies > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(names)])
