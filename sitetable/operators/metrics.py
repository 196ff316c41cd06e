"""Evaluation: task and step outcomes, label agreement, rank correlation, sync fidelity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sitetable.functions.text import in_share
from sitetable.operators.chunks import running_total
from sitetable.session import checkpointed
from sitetable.sources.targets import all_text


def task_success(trajectories: DataFrame, by: Sequence[str] = (), pages: DataFrame | None = None) -> DataFrame:
    """Share of successful trajectories, overall or by goal, status columns or columns of their page.

    Runs are counted per page before pages are joined, so a busy page is one row.
    """
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    page_cols = [] if pages is None else [c for c in by if c in pages.columns and c not in trajectories.columns]
    own = [c for c in by if c not in page_cols]
    first = list(dict.fromkeys(own + (["page_id"] if page_cols else [])))
    counts = trajectories.groupBy(*first).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))
    if page_cols:
        counts = counts.join(pages.select(F.col("id").alias("page_id"), *page_cols), "page_id", "left")
    total = counts.groupBy(*by).agg(F.sum("n").alias("n_tasks"), F.sum("n_ok").alias("n_success"))
    return total.withColumn("success_rate", F.col("n_success") / F.col("n_tasks"))


def completeness(extracted: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extracted rows over expected rows per key; ``expected`` has the keys and n_expected."""
    counts = extracted.groupBy(*keys).agg(F.count("*").alias("n_extracted"))
    return (expected.join(counts, list(keys), "left")
            .withColumn("n_extracted", F.coalesce(F.col("n_extracted"), F.lit(0)))
            .withColumn("completeness", F.col("n_extracted") / F.nullif(F.col("n_expected"), F.lit(0)))
            .select(*keys, "n_expected", "n_extracted", "completeness"))


def confusion(pairs: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    return pairs.groupBy(predicted, actual).agg(F.count("*").alias("n_rows"))


def accuracy(pairs: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Share of predictions that equal the label."""
    hit = F.coalesce(F.col(predicted) == F.col(actual), F.lit(False))
    return pairs.agg(F.count("*").alias("n_rows"), F.count_if(hit).alias("n_correct"),
                     F.avg(hit.cast("double")).alias("accuracy"))


def page_type_pairs(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Predicted and human page type for completed page-type annotations."""
    done = tasks.filter((F.col("annotation_type") == "page_type") & (F.col("status") == "completed")
                        & F.col("result.corrected_label").isNotNull())
    return (done.select("page_id", F.col("result.corrected_label").alias("actual"))
                .join(pages.select(F.col("id").alias("page_id"), F.col("page_type").alias("predicted")), "page_id"))


def role_scores(pairs: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Precision, recall and F1 per role, from the confusion counts; 0.0 where undefined."""
    counts = confusion(pairs, predicted, actual)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col(predicted).alias("role"), F.col("n_rows").alias("n_predicted"), F.lit(0).alias("n_actual"),
                 F.when(F.col(predicted) == F.col(actual), F.col("n_rows")).otherwise(F.lit(0)).alias("n_hit")),
        F.struct(F.col(actual).alias("role"), F.lit(0).alias("n_predicted"), F.col("n_rows").alias("n_actual"),
                 F.lit(0).alias("n_hit")))).alias("s")).select("s.*")
    roles = sides.groupBy("role").agg(*[F.sum(c).alias(c) for c in ("n_predicted", "n_actual", "n_hit")])

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    hit, said, real = F.col("n_hit"), F.col("n_predicted"), F.col("n_actual")
    return roles.select("role", "n_predicted", "n_actual", "n_hit", share(hit, said).alias("precision"),
                        share(hit, real).alias("recall"), share(2 * hit, said + real).alias("f1"))


def held_out_success(trajectories: DataFrame, pages: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Success rate on sites that were held out."""
    per_site = task_success(trajectories, ["site_id"], pages).filter(in_share("site_id", fraction))
    return per_site.agg(F.count("*").alias("n_sites"), F.sum("n_tasks").alias("n_tasks"),
                        F.sum("n_success").alias("n_success")) \
                   .withColumn("success_rate", F.col("n_success") / F.col("n_tasks"))


def average_ranks(df: DataFrame, value: str, times: str | None = None) -> DataFrame:
    """Average rank of each distinct value over all rows: equal values share the mean of their places.

    ``times`` names a column that says how many rows a row stands for.
    """
    counts = df.groupBy(value).agg((F.count("*") if times is None else F.sum(times)).alias("_n"))
    placed = running_total(counts, [value], "_n", "_upto")
    return placed.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho: Pearson correlation of average ranks, over rows where both are given.

    Works on counted (x, y) pairs, so repeated values cost one row; ranks come
    from range slices, never from one ordered partition.
    """
    # written once: both rankings and the sums read the counted pairs, the source is read once
    pairs = checkpointed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("_c")))
    ranked = (pairs.join(average_ranks(pairs, x, "_c").withColumnRenamed("rank", "_rx"), x)
                   .join(average_ranks(pairs, y, "_c").withColumnRenamed("rank", "_ry"), y))
    n = F.sum("_c")
    sx, sy = F.sum(F.col("_c") * F.col("_rx")), F.sum(F.col("_c") * F.col("_ry"))
    sums = ranked.agg(
        n.alias("n_rows"), (sx / n).alias("_mx"), (sy / n).alias("_my"),
        F.sum(F.col("_c") * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_c") * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(F.col("_c") * F.col("_ry") * F.col("_ry")).alias("_yy"))
    covariance = F.col("_xy") / F.col("n_rows") - F.col("_mx") * F.col("_my")
    spread = F.sqrt((F.col("_xx") / F.col("n_rows") - F.col("_mx") * F.col("_mx"))
                    * (F.col("_yy") / F.col("n_rows") - F.col("_my") * F.col("_my")))
    return sums.select("n_rows", (covariance / F.nullif(spread, F.lit(0.0))).alias("rho"))


def row_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SHA-256 of each row's text form over the given columns, nulls marked."""
    text = all_text(df.select(*columns))
    fields = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`")), F.lit("~")) for c in columns]
    return text.select(F.sha2(F.concat_ws("\u0001", *fields), 256).alias("row_hash"))


def reconcile(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that differ in number between the two sides, by row hash; copies are counted, not paired.

    One partial aggregate over both sides: no join, and a row copied many times is one key.
    """
    columns = list(columns or sorted(set(source.columns) & set(target.columns)))
    both = row_hash(source, columns).withColumn("_side", F.lit(1)).unionByName(
        row_hash(target, columns).withColumn("_side", F.lit(2)))
    return both.groupBy("row_hash").agg(F.count_if(F.col("_side") == 1).alias("n_source"),
                                        F.count_if(F.col("_side") == 2).alias("n_target"))


def fidelity(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Matched rows over source rows, with the numbers missing from and extra in the target."""
    both = reconcile(source, target, columns)
    matched = F.least("n_source", "n_target")
    return both.agg(F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target"),
                    F.sum(matched).alias("n_matched")) \
               .withColumn("fidelity", F.col("n_matched") / F.nullif(F.col("n_source"), F.lit(0)))


def _cosine(column: str, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(v)) for v in query])
    v = F.transform(F.col(column), lambda a: a.cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, r: p * r), F.lit(0.0), lambda s, p: s + p)

    norms = F.sqrt(dot(v, v)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return dot(v, q) / F.nullif(norms, F.lit(0.0))


def most_similar(vectors: DataFrame, query: Sequence[float], k: int = 10, column: str = "embedding",
                 key: str = "id") -> DataFrame:
    """The k vectors closest to ``query`` by cosine; a top-k over one scored scan."""
    return vectors.withColumn("similarity", _cosine(column, query)).orderBy(F.desc("similarity"), key).limit(k)


def most_similar_each(vectors: DataFrame, queries: Mapping[object, Sequence[float]], k: int = 10,
                      column: str = "embedding", key: str = "id") -> DataFrame:
    """The k closest vectors for each of a small batch of queries (name -> vector), ranked from 1.

    The batch goes into the plan as literals, so it should stay below some dozens; every vector is scored against
    all of them in its own row, and each task passes on only its k best per query.
    """
    scores = F.array(*[F.struct(F.lit(name).alias("query"), _cosine(column, q).alias("similarity"))
                       for name, q in queries.items()])
    rows = vectors.select(key, F.inline(scores))
    best = W.Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
