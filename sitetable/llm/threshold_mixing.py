"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id. A source that is to give ``target`` words takes each document
``floor(target / source_size)`` times, and once more the documents whose hash is below the source's threshold:
the first hash at which the running sum of sizes, in hash order, would pass the rest of the target. The threshold
is found without sorting: sums per (source, 12 hash bits) show the bucket in which it lies, only that bucket's
rows are looked at again by their next 12 bits, and so on for five levels. Reruns agree, and a larger budget takes
a superset.

Cases: a null text has size 0; a null source is a source of its own, last in order; an empty table gives an empty
result; documents of one id share a hash and are taken together; sources whose documents have no words take 0;
other columns of the input are not looked at. The rest of the target that is smaller than the next document is
left, so a source takes at most its target and misses it by less than one document (or one group of equal ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, fresh, hash60, n_words

# fixed values of the mix: weights by rank of the source, share of all words, cap per source
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
CAP = 2

DIGIT_BITS, LEVELS = 12, 5


def source_key(source: Column) -> Column:
    """Never null, and in the order of sources: code points, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def digit(value: Column, level: int) -> Column:
    return F.shiftright(value, DIGIT_BITS * (LEVELS - 1 - level)).bitwiseAND(2 ** DIGIT_BITS - 1)


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """(key, source_size) -> the same with target: shares by weight, capped, the excess dealt out again.

    Each pass caps the sources whose share is above their cap and spreads what they leave; capped sources stay
    capped, so there are no more passes than sources. The driver sees two sums a pass, and all sums are exact.
    The rank is a window over one slim row per source.
    """
    ranked = sources.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("decimal(38,0)") for w in weights]), (
        F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int")))
    size = F.col("source_size").cast("decimal(38,0)")
    num = den = None
    while True:
        full = F.lit(False) if num is None else cap * size * F.lit(den) <= F.col("w") * F.lit(num)
        words, capped, open_weight = ranked.agg(
            F.sum(size), F.sum(F.when(full, cap * size).otherwise(F.lit(0))),
            F.sum(F.when(full, F.lit(0)).otherwise(F.col("w")))).first()
        if not words or not open_weight:
            target = cap * size.cast("double")
            break
        now = (int(words) * share[0] - int(capped) * share[1], int(open_weight) * share[1])
        if (num, den) == now:
            target = F.when(full, (cap * size).cast("double")).otherwise(
                (F.col("w") * F.lit(num)).cast("double") / F.lit(den).cast("double"))
            break
        num, den = now
    return ranked.select("key", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(key, hash, size) -> a row per source: source_size, target, whole copies, threshold of the further copy."""
    cells = scratch.store(sized.groupBy("key", digit(F.col("hash"), 0).alias("digit"))
                          .agg(F.sum("size").alias("size")), "cells")
    goals = scratch.store(targets(cells.groupBy("key").agg(F.sum("size").alias("source_size")), **options), "targets")
    size, whole = F.col("source_size"), F.col("whole")
    state = goals.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    state = state.select("*", (F.col("target") - whole * size).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    state = scratch.store(state, "state")
    rows = sized
    for level in range(LEVELS):
        running = Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        passed = cells.withColumn("upto", F.sum("size").over(running)).join(state.select("key", "rest"), "key") \
            .filter(F.col("upto") > F.col("rest")).groupBy("key") \
            .agg(F.min(F.struct("digit", (F.col("upto") - F.col("size")).alias("below"))).alias("cut"))
        # a source without a cut takes all: a threshold above every hash, kept by later levels
        state = scratch.store(state.join(passed, "key", "left").select(
            "key", "source_size", "target", "whole",
            (F.col("rest") - F.coalesce("cut.below", F.lit(0))).alias("rest"),
            F.when(F.col("prefix") < 0, F.col("prefix")).when(F.col("cut").isNull(), -1)
            .otherwise(F.shiftleft("prefix", DIGIT_BITS) + F.col("cut.digit")).alias("prefix")), f"state{level}")
        if level + 1 < LEVELS:
            marks = state.filter("prefix >= 0").select("key", F.col("prefix").bitwiseAND(2 ** DIGIT_BITS - 1).alias("d"))
            rows = scratch.store(rows.withColumn("d", digit(F.col("hash"), level)).join(marks, ["key", "d"], "left_semi")
                                 .drop("d"), f"boundary{level}")
            cells = rows.groupBy("key", digit(F.col("hash"), level + 1).alias("digit")).agg(F.sum("size").alias("size"))
    below = F.when(F.col("prefix") < 0, F.lit(2 ** 62)).otherwise(F.col("prefix"))
    return scratch.store(state.select("key", "source_size", "target", "whole", below.alias("below")), "thresholds",
                         result=True)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **options) -> DataFrame:
    """Per document: its id, size, source_size, target, copies the mix holds and taken words."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.store(docs.select(col(id_col).alias("id"), source_key(col(source_col)).alias("key"),
                                      hash60(col(id_col)).alias("hash"), n_words(col(text_col)).alias("size")),
                          "sized", result=True)
    cuts = thresholds(sized, scratch, **options)
    scratch.clear()
    copies = F.col("whole") + (F.col("hash") < F.col("below")).cast("long")
    return sized.join(cuts, "key").select(F.col("id").alias(id_col), "size", "source_size", "target",
                                          copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  **options) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, all columns kept."""
    scratch = Scratch(docs.sparkSession, "mixing")
    key, hashed = (fresh(docs.columns, c) for c in ("mix_key", "mix_hash"))
    sized = scratch.store(docs.select(source_key(col(source_col)).alias("key"), hash60(col(id_col)).alias("hash"),
                                      n_words(col(text_col)).alias("size")), "sized")
    cuts = thresholds(sized, scratch, **options)
    scratch.clear()
    whole, below = (fresh([*docs.columns, key, hashed], c) for c in ("mix_whole", "mix_below"))
    cuts = cuts.select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("below").alias(below))
    copies = (F.col(whole) + (F.col(hashed) < F.col(below)).cast("long")).cast("int")
    return (docs.withColumns({key: source_key(col(source_col)), hashed: hash60(col(id_col))}).join(cuts, key)
            .withColumn(below, F.explode(F.array_repeat(F.lit(0), copies))).select(*[col(c) for c in docs.columns]))
