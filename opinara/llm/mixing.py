"""Mixing of sources to target weights by entropy balancing.

A document may be taken up to twice. Among all rates between 0 and 2 that give every source its target
number of words, the ones nearest to 1 in (two-sided) entropy are 2 / (1 + exp(-tilt * size)): the sizes
are tilted exponentially, with one tilt per source. The tilts solve a convex dual; its gradient and
curvature are sums over documents, so each Newton step is one distributed aggregation, over a
histogram of sizes per source. Rates become copies by systematic rounding: within a source, documents
are ordered by size, rates are summed up, and a document is taken whenever the running sum passes an
integer. Neighbours in that order have nearly equal sizes, so rounding errors cancel.

All sums are of integers (rates are fixed-point), so reruns and other partitionings agree.

Defined results: null text has size 0; documents of size 0 get no copy. A null source is a source of its own,
after all others. Sources without words have target 0. Repeated rows are separate documents. An empty
table gives an empty table. Columns of the input that clash with output names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import global_index, running_total
from .common import Scratch, apart

MAX_RATE = 2
STEPS = 200  # safety bound; bisection alone halves the bracket each step
_FIXED_BITS = 24
_FIXED = 1 << _FIXED_BITS


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.size(F.filter(F.split(plain, " +"), lambda w: w != ""))
    return F.when(text.isNull(), F.lit(0)).otherwise(words).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float) -> DataFrame:
    """Rows (source, source_size, target) from (source, size, n): weights cycle over the ordered sources.

    Targets are shares of ``share`` times all words, at most twice the words of the source; what
    exceeds that is shared again by weight. The level at which this settles is found from running
    totals over the sources in the order in which they reach their limit.
    """
    scratch = Scratch(sizes.sparkSession)
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # UTF-8 bytes sort by code point. Nulls come last.
    ranked = global_index(per.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "_rank")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = ranked.withColumn("_w", F.get(weights, F.pmod(F.col("_rank") - 1, F.lit(len(cycle))).cast("int")))
    ranked = ranked.withColumns({"_cap": F.col("source_size") * MAX_RATE})
    ranked = scratch.write(ranked.withColumn("_level", F.col("_cap") / F.col("_w")), "ranked")
    total, weight = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("_w")).first())
    want = total * share
    filled = scratch.write(running_total(ranked, ["_level", "_rank"], {"_caps": "_cap", "_weights": "_w"}), "filled")
    # If only the sources up to this one were full, the others would settle at this level. The true level is
    # the largest of these: filling too few or too many sources can only lower it.
    rest = F.when(F.lit(weight) - F.col("_weights") > 0.5 * min(cycle),
                  (F.lit(want) - F.col("_caps")) / (F.lit(weight) - F.col("_weights")))
    level = max(want / weight if weight else 0.0, filled.agg(F.max(rest)).first()[0] or 0.0)
    target = F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, size: Column, scale: Column, full: Column) -> Column:
    """Fixed-point rate: 2 / (1 + exp(-tilt * size / scale)), exactly 2 where the target takes everything twice."""
    rate = F.lit(float(MAX_RATE)) / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size / scale))))
    return F.when(full, F.lit(MAX_RATE * _FIXED)).otherwise(F.floor(rate * _FIXED)).cast("long")


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (source, source_size, target, tilt, scale, full) from the histogram (source, size, n).

    Newton steps, each kept inside a shrinking bracket, until every source meets its target as closely
    as fixed-point rates can tell.
    """
    scratch = Scratch(sizes.sparkSession)
    means = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.join(means.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    state = state.withColumns({
        "full": F.col("target") >= F.col("source_size") * float(MAX_RATE) * (1 - 1e-12),
        "scale": F.greatest(F.col("scale"), F.lit(1e-9)),
        "tilt": F.lit(0.0), "lo": F.lit(-1e6), "hi": F.lit(1e6)})
    state = state.withColumn("done", F.col("full") | (F.col("source_size") == 0))
    state = scratch.write(state, "state-0")
    hist = sizes.filter("size > 0").withColumnRenamed("source", "_s")
    for step in range(1, STEPS + 1):
        if state.filter("not done").isEmpty():
            return state.drop("lo", "hi", "done")
        open_ = state.filter("not done")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("scale"), F.col("full"))
        terms = hist.join(open_, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_r", rate)
        words = (F.col("size") * F.col("n")).cast("decimal(38,0)")
        x = F.col("size") / F.col("scale")
        slope = F.floor(F.col("_r") / _FIXED * (MAX_RATE - F.col("_r") / _FIXED) / MAX_RATE * x * _FIXED).cast("long")
        sums = terms.groupBy("_s").agg(F.sum(words * F.col("_r")).alias("_got"), F.sum(words * slope).alias("_slope"))
        sums = scratch.write(sums, f"sums-{step}")
        new = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        gap = F.col("_got").cast("double") / _FIXED - F.col("target")
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        new = new.withColumns({"_gap": gap, "lo": lo, "hi": hi})
        newton = F.col("tilt") - F.col("_gap") / (F.col("_slope").cast("double") / _FIXED)
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        # Outside the bracket: double the tilt while one side is open, halve the bracket afterwards.
        wide = F.when(F.col("_gap") < 0, F.greatest(F.lit(1.0), F.col("tilt") * 4)).otherwise(F.least(F.lit(-1.0), F.col("tilt") * 4))
        opened = F.when(F.col("_gap") < 0, F.col("hi") >= 1e6).otherwise(F.col("lo") <= -1e6)
        guess = F.when((F.col("_slope") > 0) & inside & (F.abs(newton) < 1e6), newton).when(opened, wide).otherwise(
            (F.col("lo") + F.col("hi")) / 2)
        met = (F.abs("_gap") <= F.greatest(F.lit(0.01), F.col("target") * 1e-6)) | (F.col("hi") - F.col("lo") < 1e-9)
        done = F.col("done") | F.coalesce(met, F.lit(True))
        state = scratch.write(new.select(
            "source", "source_size", "target", "scale", "full", F.when(done, F.col("tilt")).otherwise(guess).alias("tilt"),
            "lo", "hi", done.alias("done")), f"state-{step}")
    raise RuntimeError(f"tilts have not settled after {STEPS} steps")


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, text_key, size, source, source_size, target, copies, taken), one per document."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("text_key"), word_count(text).alias("size"),
                       F.col(f"`{source_col}`").cast("string").alias("source"))
    rows = scratch.write(rows, "rows")
    sizes = scratch.write(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    state = scratch.write(balance(sizes, source_targets(sizes, cycle, share)), "tilts")

    # Rates are equal for equal sizes: running sums of whole sizes come from the histogram, so only the
    # place of a document among those of its source and size is left to number.
    rate = _rate(F.col("tilt"), F.col("size"), F.col("scale"), F.col("full"))
    rated = sizes.withColumnRenamed("source", "_s").join(state, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0).cast("long")))
    rated = rated.withColumns({"_name": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")),
                               "_mass": F.col("rate") * F.col("n")})
    rated = scratch.write(rated.drop("_s", "tilt", "scale", "full", "n"), "rated")
    upto = running_total(rated, ["_name", "size"], {"_upto": "_mass"})
    # The running sum goes on from source to source; what came before the source is taken off.
    first = upto.groupBy("_name").agg(F.min(F.col("_upto") - F.col("_mass")).alias("_base"))
    upto = scratch.write(upto.join(first, "_name").select(
        "_name", "size", "source_size", "target", "rate", (F.col("_upto") - F.col("_mass") - F.col("_base")).alias("_before")), "upto")
    named = rows.withColumn("_name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    numbered = global_index(named, ["_name", "size", F.xxhash64("text_key", "_id"), "_id"], "_n").drop("_at")
    starts = numbered.groupBy("_name", "size").agg(F.min("_n").alias("_first"))
    starts = scratch.write(starts.join(upto, ["_name", "size"]), "starts")
    placed = scratch.write(numbered, "numbered").join(starts, ["_name", "size"])
    begin = F.col("_before") + (F.col("_n") - F.col("_first")) * F.col("rate") + F.lit(_FIXED // 2)
    copies = F.shiftright(begin + F.col("rate"), _FIXED_BITS) - F.shiftright(begin, _FIXED_BITS)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")))
    return placed.select(F.col("_id").alias(id_col), "text_key", "size", F.col("source").alias(source_col), "source_size",
                         "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them.

    Rows that repeat id, text and source are told apart by numbering them on both sides.
    """
    scratch = Scratch(docs.sparkSession)
    given = docs.columns
    docs, (id_col, text_col, source_col) = apart(docs, id_col, text_col, source_col)
    mixed = mix(docs, cycle, share, id_col, text_col, source_col)
    names = {"_name": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
             "_from": F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("t"))}
    # All rows of one id, text and source are equal in what the mix sees, so only their copies count.
    copies = mixed.withColumns(names).groupBy("_name", "_from", "text_key").agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    copies = scratch.write(copies, "copies")
    rows = docs.withColumns({**names, "text_key": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    keys = ["_name", "_from", "text_key"]
    joined = rows.join(copies, keys)
    alone = joined.filter("_rows = 1").withColumn("_take", F.col("_copies"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    again = joined.filter("_rows > 1").withColumn("_nth", nth)
    share_of = F.floor(F.col("_copies") * F.col("_nth") / F.col("_rows")) - F.floor(F.col("_copies") * (F.col("_nth") - 1) / F.col("_rows"))
    again = again.withColumn("_take", share_of.cast("long")).drop("_nth")
    taken = alone.unionByName(again).filter("_take > 0")
    times = F.explode(F.array_repeat(F.lit(1), F.col("_take").cast("int")))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], times.alias("_time")).drop("_time").toDF(*given)
