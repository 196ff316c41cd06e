"""Registered queries of the thirteen operators, over whole tables with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    automaton_search,
    histogram_packing,
    host_trust,
    kmeans_tree,
    maglev_shards,
    ordinal_quality,
    phrase_graph,
    risk_rules,
    secret_owners,
    suffix_dedup,
    threshold_mixing,
    weighted_minhash,
    zip_warc,
)
from .common import Scratch, read_table

BATCH_ROWS = "1000"  # rows of a Python batch: documents may be long


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents")
    ratings = ordinal_quality.grades_from_labels(read_table(spark, sf_dir, "labels"))
    sample = ordinal_quality.fit_sample(docs, ratings)
    model, cutoff = ordinal_quality.fit_with_cutoff(sample, 3)
    return ordinal_quality.score(docs, model, select_tail=cutoff)


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(read_table(prepared(spark), sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack(read_table(prepared(spark), sf_dir, "documents"), tokenizer_path())


def op4_maglev_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return maglev_shards.with_shards(docs, "doc_id").select("doc_id", "slot", "shard")


def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(prepared(spark), "warc").path("archives", result=True)
    return zip_warc.round_trip(read_table(spark, sf_dir, "pages"), folder)


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(read_table(prepared(spark), sf_dir, "documents"))


def op7_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge_pages(read_table(prepared(spark), sf_dir, "pages"))


def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(read_table(prepared(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_mixing.mix_counts(read_table(prepared(spark), sf_dir, "documents"))


def op10_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_owners.scan(read_table(prepared(spark), sf_dir, "documents")).drop("key", "found")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_table(prepared(spark), sf_dir, "documents"))


def op12_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(read_table(prepared(spark), sf_dir, "documents"))


def op13_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_search.search(read_table(prepared(spark), sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ordinal_quality, op2_kmeans_tree, op3_histogram_packing, op4_maglev_shards, op5_zip_warc,
    op6_weighted_minhash, op7_host_trust, op8_risk_rules, op9_threshold_mixing, op10_secret_owners,
    op11_suffix_dedup, op12_phrase_graph, op13_automaton_search)}

_UPPER, _LOWER = automaton_search.UPPER, automaton_search.LOWER
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{automaton_search.TERM}')"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(b), {1 + 5 * i}, 5))::BIGINT >> {15 - 5 * j}) & 31)::INT, 1)"
    for i in range(8) for j in range(4))

ORACLES: dict[str, str] = {
    "op5_zip_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p GROUP BY b)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (b)""",
    # caps by closed form: sources in the order of cap per weight are capped while the rest's share is above their cap
    "op9_threshold_mixing": f"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY n::DOUBLE / w, source) AS k FROM w),
c AS (SELECT *, sum(2 * n) OVER (ORDER BY k) AS capped, sum(w) OVER () - sum(w) OVER (ORDER BY k) AS open_w,
             sum(n) OVER () AS total FROM o),
l AS (SELECT k, capped, open_w, total, lead(2 * n) OVER (ORDER BY k) AS next_cap, lead(w) OVER (ORDER BY k) AS next_w FROM c
      UNION ALL SELECT 0, 0, sum(w), sum(n), arg_min(2 * n, k), arg_min(w, k) FROM o),
cut AS (SELECT k AS upto, (3 * total - 2 * capped)::BIGINT AS num, (2 * open_w)::BIGINT AS den FROM l
        WHERE open_w > 0 AND (3 * total - 2 * capped) * next_w <= next_cap * 2 * open_w ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN k <= upto THEN (2 * n)::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM o, cut),
e AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM t),
m AS (SELECT d.*, e.n, e.target, e.whole, e.target - e.whole * e.n AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, whole + (upto <= rest)::BIGINT AS copies,
       ((whole + (upto <= rest)::BIGINT) * size)::BIGINT AS taken FROM m""",
    # strings by their 50 bytes, removed runs by the gaps between their starts, and what lies between the runs
    "op11_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT k, doc_id, unnest(range(1, octet_length(b) - 48)) AS s FROM d WHERE doc_id IS NOT NULL AND octet_length(b) >= 50),
x AS (SELECT p.k, p.doc_id, p.s, md5(d.b[p.s:p.s + 49]) AS w FROM p JOIN d USING (k)),
m AS (SELECT w, min(doc_id) AS least FROM x GROUP BY w),
r AS (SELECT k, s FROM x JOIN m USING (w) WHERE least < doc_id),
g AS (SELECT k, s, CASE WHEN s <= lag(s) OVER (PARTITION BY k ORDER BY s) + 50 THEN 0 ELSE 1 END AS opens FROM r),
n AS (SELECT k, s, sum(opens) OVER (PARTITION BY k ORDER BY s) AS run FROM g),
spans AS (SELECT k, run, min(s) AS a, max(s) + 50 AS z FROM n GROUP BY k, run),
cuts AS (SELECT k, a, z FROM spans UNION ALL SELECT k, octet_length(b) + 1, octet_length(b) + 1 FROM d),
kept AS (SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a, z), 1) AS a, a AS z FROM cuts),
left_over AS (SELECT kept.k, string_agg(CASE WHEN kept.a < kept.z THEN hex(d.b[kept.a:kept.z - 1]) ELSE '' END, '' ORDER BY kept.a, kept.z) AS x
              FROM kept JOIN d USING (k) GROUP BY kept.k),
sums AS (SELECT k, sum(z - a) AS removed, count(*) AS spans FROM spans GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(x)) AS kept_sha256
FROM d JOIN left_over USING (k) LEFT JOIN sums USING (k)""",
    "op12_phrase_graph": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, f AS a, j, array_to_string(g[1:j], ' ') AS x, array_to_string(g[j + 1:k], ' ') AS y
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(g[b:b + z - 1], ' ') AS phrase, max(f) AS longer
      FROM (SELECT *, unnest(range(1, k - z + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS z FROM c WHERE k > 2)) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_automaton_search": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT sum(len(w))::BIGINT AS total, count(*)::BIGINT AS docs FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY k, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
x AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, c),
m AS (SELECT k, doc_id, 100 - 90 + ((90 * len(w) * docs) // total) AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item_id, m.k, any_value(m.doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN x USING (term) JOIN m ON m.k = t.k GROUP BY item_id, m.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
