"""Quality rules whose cutoffs carry a risk guarantee, in DataFrame functions only.

Every rule compares two counts of a text: it rejects where 100 * numerator > cutoff * denominator. Which cutoff of
a rule's grid may be used is decided on labelled documents, in a pool: a stratum (language, length band) that has
enough good ones to admit a cutoff at all, else its language if that has, else all labels. With n good ones in the
pool of which k would be rejected, the exact binomial test at the rate r gives p = P(Bin(n, r) <= k) for "the false
rejection rate is above r"; r is the allowed false rejection divided by the number of rules that reject a bad
document of the pool, so a pool loses at most ``risk`` of its good documents.

A rule's cutoffs are tested from mild to strict up to the first failure, which needs no correction for the grid. The
pairs of pool and rule share ``delta`` by Holm's method: with m pairs of which c have admitted their whole grid, the
others are tested at delta / (m - c). So all admitted cutoffs hold at once with probability 1 - delta. Which rules
take part depends on the bad documents alone, not on the good ones that are tested. A stratum that uses its
language's cutoffs, or all labels', has the guarantee for that whole pool, not for itself. Of the admitted cutoffs
the one that rejects most bad documents is taken (ties: fewest good ones, then the mildest); a rule that rejects no
bad one, or has too few labels, stays off.

Cases: null and blank texts have no words and fail the base rule; a null or unlisted language counts as ``other``;
contradicting labels of an id count as bad, null labels not at all; a labelled id is one trial however often
its row is there (of an id with several texts one counts), and copies under ids of their own are trials when they have labels of
their own; without labels only the base rule works; an
empty table gives an empty result; repeated rows are judged alike; other columns keep out of the way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, words_of

# fixed values: symbols of the base counts, limits of the base rule
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# rule: numerator, denominator, cutoffs in percent from strict to mild
RULES = {
    "symbols": ("n_symbols", "word_chars", (1, 2, 3, 5, 8, 12, 20)),
    "repeats": ("n_repeat_words", "n_words", (5, 10, 15, 20, 25, 30, 35, 40, 45)),
    "dup_lines": ("n_dup_lines", "n_words", (1, 2, 3, 5, 8)),
    "long_words": ("word_chars", "n_words", (600, 650, 700, 800, 900, 1000, 1200)),
    "short_words": ("n_words", "word_chars", (18, 20, 22, 25, 30, 40)),
}
LANGS = ("de", "en", "es", "fr")
BANDS = (200, 1000)
RISK, DELTA = 0.01, 0.05
STRATA = [(lang, f"{lang}/{band}") for lang in (*LANGS, "other") for band in range(len(BANDS) + 1)]


def base_stats(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the five counts of every text.

    Repeated windows are found within the row: each window's hash and position share one long, so a primitive
    sort brings equal windows together; neighbours are then compared word by word.
    """
    body = F.coalesce(text, F.lit(""))
    step = docs.select(*keep, body.alias("_text"), words_of(text).alias("_w"))
    step = step.withColumns({"_n": F.size("_w"), "_b": F.length(F.bin(F.size("_w").cast("long")))})
    step = step.withColumn("_keys", F.expr(
        "sort_array(transform(slice(_w, 1, greatest(_n - 2, 0)), (x, i) -> "
        "shiftleft(xxhash64(x, _w[i + 1], _w[i + 2]), _b) | cast(i as bigint)))"))
    at = "cast(_keys[{0}] & (shiftleft(1L, _b) - 1) as int)"
    near = f"shiftright(_keys[i], _b) = shiftright(_keys[i + 1], _b) AND slice(_w, {at.format('i')} + 1, 3) = " \
           f"slice(_w, {at.format('i + 1')} + 1, 3)"
    step = step.withColumn("_same", F.expr(
        f"transform(slice(_keys, 1, greatest(size(_keys) - 1, 0)), (x, i) -> {near})"))
    # positions of windows that equal a neighbour in the sorted order, in text order
    step = step.withColumn("_hits", F.expr(
        "CASE WHEN NOT array_contains(_same, true) THEN cast(array() AS array<int>) ELSE "
        "sort_array(transform(filter(_keys, (x, i) -> (i > 0 AND _same[greatest(i - 1, 0)]) OR coalesce(get(_same, i), false)), "
        "x -> cast(x & (shiftleft(1L, _b) - 1) as int))) END"))
    repeat = F.expr("aggregate(_hits, named_struct('last', -3, 'n', 0L), (s, p) -> "
                    "named_struct('last', p, 'n', s.n + least(3, p - s.last)), s -> s.n)")
    lines = F.expr(r"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    step = step.withColumn("_lines", lines)
    return step.select(
        *[c for c in step.columns if not c.startswith("_")], F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def stratum(lang: Column, n_words: Column) -> Column:
    """One of STRATA's names."""
    name = F.when(lang.isin(*LANGS), lang).otherwise("other")
    band = sum(((n_words >= b).cast("int") for b in BANDS), F.lit(0))
    return F.concat_ws("/", name, band.cast("string"))


def _over(rule: str, cutoff) -> Column:
    num, den, _ = RULES[rule]
    return 100 * F.col(num) > cutoff * F.col(den)


def _ln_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, brought back by the recurrence; good to 1e-12 for x >= 1."""
    y = x + 10
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (
        1260 * y * y * y * y * y)
    for i in range(10):
        series = series - F.ln(x + i)
    return series


def binomial_tail(n: Column, k: Column, rate: float | Column) -> Column:
    """P(Bin(n, rate) <= k) for k <= n * rate, summed down from k until the terms are below 1e-20 of the sum."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * F.ln(F.lit(rate))
                + (n - k) * F.ln(F.lit(1 - rate)))
    steps = F.least(k, 10 * F.sqrt(n * rate) + 100).cast("int")
    ratio = (1 - rate) / rate

    def add(state, j):
        term = state["term"] * (k - j) * F.lit(ratio) / (n - k + j + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), start, add,
                                           lambda s: s["total"])).otherwise(1.0)
    return top * series


def cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality",
            risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff per rule or null) from documents' stats; a row per stratum.

    The tests, a row per pool and cutoff, are stored before their tails are computed: the optimizer would
    otherwise carry the long formula through every rule.
    """
    spark = stats.sparkSession
    scratch = Scratch(spark, "tests")
    marks = labels.filter(col(quality_col).isNotNull()).groupBy(col(id_col).alias(id_col)) \
        .agg(F.min(col(quality_col)).alias("_good"))
    # one trial per labelled id: rows that repeat it tell nothing new, and the bound holds for independent trials only
    held = stats.join(marks, id_col).groupBy(id_col).agg(F.min(F.struct("stratum", *STATS)).alias("trial"), F.min("_good").alias("_good"))
    held = held.select("trial.*", "_good")
    good, bad = F.col("_good") >= 1, F.col("_good") < 1
    tests = [(rule, c) for rule, (_, _, grid) in RULES.items() for c in grid]
    counts = held.groupBy("stratum").agg(
        F.sum(good.cast("long")).alias("n"),
        F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"),
                           F.sum((good & _over(rule, c)).cast("long")).alias("k"),
                           F.sum((bad & _over(rule, c)).cast("long")).alias("bad")) for rule, c in tests]).alias("t"))
    counts = scratch.store(counts.select("stratum", "n", F.inline("t")), "counts")
    lang = F.substring_index("stratum", "/", 1)
    pooled = counts.withColumn("pool", F.explode(F.array("stratum", lang, F.lit("all")))).groupBy("pool", "rule", "cutoff").agg(
        *[F.sum(c).alias(c) for c in ("n", "k", "bad")])
    pooled = scratch.store(pooled, "pooled")
    # good documents that admit a cutoff without false rejections whatever the other pairs do
    least = math.ceil(math.log(delta / (len(STRATA) * len(RULES))) / math.log(1 - risk / len(RULES)))
    large = pooled.filter(F.col("n") >= least).select("pool").distinct()
    strata = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("lang"), F.lit(b).alias("stratum")) for a, b in STRATA])))
    strata = strata.join(F.broadcast(large.select(F.col("pool").alias("stratum"), F.col("pool").alias("own"))), "stratum", "left") \
        .join(F.broadcast(large.select(F.col("pool").alias("lang"), F.col("pool").alias("wider"))), "lang", "left")
    strata = scratch.store(strata.select("stratum", F.coalesce("own", "wider", F.lit("all")).alias("pool")), "strata")
    rows = pooled.filter("bad > 0").join(F.broadcast(strata.select("pool").distinct()), "pool", "left_semi")
    active = rows.groupBy("pool").agg(F.count_distinct("rule").alias("rules"))
    rows = scratch.store(rows.join(F.broadcast(active), "pool").withColumn("rate", F.lit(float(risk)) / F.col("rules")), "rated")
    tail = F.when(F.col("k") <= F.col("n") * F.col("rate"), binomial_tail(F.col("n"), F.col("k"), F.col("rate"))).otherwise(1.0)
    rows = scratch.store(rows.withColumn("p", tail), "tails")
    # stricter cutoffs reject what milder ones do, so p grows along a grid and its largest is the last test
    pairs = rows.groupBy("pool", "rule").agg(F.max("p").alias("last")).agg(F.sort_array(F.collect_list("last")).alias("lasts"))
    whole = F.aggregate("lasts", F.lit(0), lambda c, p: F.when(
        p <= delta / (F.size("lasts") - c), c + 1).otherwise(c))
    level = pairs.select((delta / F.greatest(F.size("lasts") - whole, F.lit(1))).alias("level"))
    chosen = rows.crossJoin(F.broadcast(level)).filter("p <= level").groupBy("pool", "rule") \
        .agg(F.max_by("cutoff", F.struct(F.col("bad"), -F.col("k"), F.col("cutoff"))).alias("cutoff"))
    chosen = chosen.groupBy("pool").agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES])
    found = scratch.store(strata.join(F.broadcast(chosen), "pool", "left").drop("pool"), "cutoffs", result=True)
    scratch.clear()
    return found


def passes() -> Column:
    """Neither the base rule nor an admitted cutoff rejects the row.

    The least of booleans, not their conjunction: the optimizer must not split it and push a part below the counts,
    where it would copy their formulas.
    """
    return F.least(~base_failed(), *[~F.coalesce(_over(rule, F.col(f"cut_{rule}")), F.lit(False)) for rule in RULES])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          **options) -> DataFrame:
    """Per document: id, the five counts, stratum, base_failed, kept."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = base_stats(docs, col(text_col), [col(id_col).alias(id_col), col(lang_col).alias("stratum_lang")])
    stats = stats.withColumn("stratum", stratum(F.col("stratum_lang"), F.col("n_words"))).drop("stratum_lang")
    stats = scratch.store(stats, "stats", result=True)
    found = cutoffs(stats, labels, id_col, **options)
    # at most (languages + 1) * (bands + 1) rows
    judged = stats.join(F.broadcast(found), "stratum", "left")
    return judged.select(id_col, *STATS, "stratum", base_failed().alias("base_failed"), passes().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", **options) -> DataFrame:
    """The documents that pass, all columns kept; the text never leaves its scan task."""
    scratch = Scratch(docs.sparkSession, "rules")
    names = docs.columns
    stats = base_stats(docs, col(text_col), [col(id_col).alias(id_col), col(lang_col).alias("stratum_lang")])
    stats = scratch.store(stats.withColumn("stratum", stratum(F.col("stratum_lang"), F.col("n_words"))), "stats")
    found = cutoffs(stats, labels, id_col, **options)
    scratch.clear()
    packed = docs.select(F.struct(*[col(c) for c in names]).alias("row"))
    counted = base_stats(packed, F.col("row")[text_col], [F.col("row")])
    counted = counted.withColumn("stratum", stratum(F.col("row")[lang_col], F.col("n_words")))
    kept = counted.join(F.broadcast(found), "stratum", "left").filter(passes())
    return kept.select(*[F.col("row")[c].alias(c) for c in names])
