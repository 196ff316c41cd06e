"""Phrase collocations from a weighted de Bruijn graph of words.

Texts, A-Z lower-cased, are split into pieces at ``.,;:!?`` and line ends and pieces into words at blanks and tabs. Every
word position of a piece gives one longest gram: four words, fewer where the piece ends. Four words are an edge between
the three-word nodes that overlap in it, and its weight is the number of its occurrences. The occurrences of a shorter
gram are the flow out of its node (the weights of all edges that begin with it) plus the piece-end corrections (the
shorter longest grams that begin with it), so one aggregate of longest grams gives all counts. Nodes that only one path
leaves with their whole weight are compacted: a path is one row that stands for all its prefixes.

A batch of texts of a language is counted at once and its distinct grams go to buckets, packed, by a hash of their first
two words: all grams that share a node then meet in a task, and a bucket holds about ``bucket_bytes`` of text. Pairs that
begin more than ``HOT_COUNT`` grams of a bounded sample of the documents are spread by their third word, and such triples
by their fourth; their counts are then sums over buckets. The sample settles balance only, never counts. Pieces of
the result (grams of at least ``least`` occurrences, at most a ``least``-th of all words) are joined in DataFrames.

A candidate's score is the least over its cuts of ``floor(2000000 a / (l + r))`` (decimal arithmetic); candidates inside a
longer candidate that has at least ``inside_percent`` of their occurrences are dropped.

Cases: a null text has no words and a null language is ``und``; empty texts and those of separators only count nothing;
rows that repeat count each time; ties in score go to more occurrences, then to the smaller phrase in byte order; an
empty table gives an empty result; other columns are not looked at; texts of any length are taken whole.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, TOP, INSIDE_PERCENT = 30, 2000, 80
FLUSH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SAMPLE_BYTES, HOT_COUNT = 32 << 20, 64
GRAMS = "lang string, phrase string, low int, high int, f long"
_SEED = np.uint64(0x9E3779B97F4A7C15)

# fixed values: where pieces end, and what parts words
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_ENDS)] = 1
_KIND[list(PIECE_ENDS)] = 2


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b + _SEED)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and of each word occurrence its number among them (from 1) and its piece."""
    buf = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    kind = _KIND[buf]
    letter = kind == 0
    begins = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    ends = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)),
                                             pa.py_buffer(buf[letter])).dictionary_encode()
    return words.dictionary, np.asarray(words.indices).astype(np.int64) + 1, np.cumsum(kind == 2)[begins]


def longest_grams(word: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """Four columns of word numbers, a row per word; 0 beyond the piece's end."""
    columns = [word]
    for step in (1, 2, 3):
        after = np.zeros_like(word)
        if len(word) > step:
            after[:-step] = np.where(piece[step:] == piece[:-step], word[step:], 0)
        columns.append(after)
    return columns


def counted(columns: list[np.ndarray], counts: np.ndarray, flags: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct rows in order, as two packed keys, with their summed counts (and the flags of one of them)."""
    high, low = (columns[0] << 32) | columns[1], (columns[2] << 32) | columns[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return high[at], low[at], sums, None if flags is None else flags[order][at]


def _hashes(words: pa.Array) -> np.ndarray:
    """Hash of each word, and before them that of no word."""
    return np.array([0] + [xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


def _node_hashes(h: np.ndarray, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    two = _mixed(h[high >> 32], h[high & 0xFFFFFFFF])
    three = _mixed(two, h[low >> 32])
    return [two, three, _mixed(three, h[low & 0xFFFFFFFF])]


def _member(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _pack(words: pa.Array, columns: list[np.ndarray], counts: np.ndarray, flags: np.ndarray) -> bytes:
    """Grams with the words they use, compressed."""
    used, numbers = np.unique(np.concatenate(columns), return_inverse=True)
    if used[0] != 0:
        used, numbers = np.concatenate([[0], used]), numbers + 1
    held = words.take(pa.array(used[1:] - 1))
    text = "\n".join(held.to_pylist()).encode()  # no word holds a line end
    head = np.array([len(counts), len(used) - 1, len(text)], np.int64).tobytes()
    body = b"".join([head, text, numbers.astype("<i4").tobytes(), counts.astype("<i8").tobytes(), flags.tobytes()])
    return np.int64(len(body)).tobytes() + pa.Codec("zstd", 1).compress(body, asbytes=True)


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    body = pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True)
    n, _, size = (int(x) for x in np.frombuffer(body, np.int64, 3))
    at = 24 + size
    numbers = np.frombuffer(body, "<i4", 4 * n, at).reshape(4, n)
    counts = np.frombuffer(body, "<i8", n, at + 16 * n)
    return body[24:at].split(b"\n"), numbers, counts, np.frombuffer(body, np.uint8, n, at + 24 * n)


def _by_language(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``limit`` bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= limit:
                yield lang, held.pop(lang)
                size[lang] = 0
        if sum(size.values()) >= 2 * limit:  # many languages: let the largest go
            lang = max(size, key=size.get)
            yield lang, held.pop(lang)
            size[lang] = 0
    yield from ((lang, texts) for lang, texts in held.items() if texts)


def _batch_grams(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; distinct grams of two words or more with counts; occurrences of each word."""
    words, word, piece = tokens(texts)
    columns = longest_grams(word, piece)
    edge = columns[1] > 0
    high, low, counts, _ = counted([c[edge] for c in columns], np.ones(int(edge.sum()), np.int64))
    return words, high, low, counts, np.bincount(word, minlength=len(words) + 1)[1:]


def hot_nodes(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs and triples that begin ``HOT_COUNT`` grams or more of a sample of ``SAMPLE_BYTES``.

    The sample has fewer than SAMPLE_BYTES / 2 words, so the lists have fewer than SAMPLE_BYTES / HOT_COUNT entries.
    """
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_language(batches, FLUSH_BYTES):
            words, high, low, counts, _ = _batch_grams(held)
            for size, h in enumerate(_node_hashes(_hashes(words), high, low)[:2], 2):
                keys, at = np.unique(h.view(np.int64), return_inverse=True)
                sums = np.bincount(at, counts, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys),
                                                  pa.array(sums)], ["size", "node", "n"]).filter(pa.array(sums > 1))

    found = (part.mapInArrow(nodes, "size int, node long, n long").groupBy("size", "node").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= HOT_COUNT).select("size", "node").collect())
    return tuple(np.sort(np.array([r.node for r in found if r.size == size], np.int64).view(np.uint64)) for size in (2, 3))


def packed_grams(texts: DataFrame, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """bucket, lang, blob: the grams and words of batches of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples = shared.value
        for lang, held in _by_language(batches, FLUSH_BYTES):
            words, high, low, counts, alone = _batch_grams(held)
            if not len(words):
                continue
            h = _hashes(words)
            two, three, four = _node_hashes(h, high, low)
            hot2 = _member(two, pairs)
            hot3 = hot2 & _member(three, triples)
            route = np.where(hot3, four, np.where(hot2, three, two))
            numbers = np.arange(1, len(words) + 1)
            none = np.zeros_like(numbers)
            columns = [np.concatenate(c) for c in ((high >> 32, numbers), (high & 0xFFFFFFFF, none),
                                                   (low >> 32, none), (low & 0xFFFFFFFF, none))]
            counts = np.concatenate([counts, alone])
            flags = np.concatenate([hot2 + 2 * hot3, none]).astype(np.uint8)
            bucket = (np.concatenate([route, h[1:]]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            which, begins = np.unique(bucket[order], return_index=True)
            blobs = [_pack(words, [c[part] for c in columns], counts[part], flags[part])
                     for part in np.split(order, begins[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([lang] * len(which)),
                                              pa.array(blobs, pa.binary())], ["bucket", "lang", "blob"])

    return texts.mapInArrow(pack, "bucket int, lang string, blob binary")


def _first(begins: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(begins) - 1 if n else np.zeros(0, np.int64)


def paths(high: np.ndarray, low: np.ndarray, counts: np.ndarray, flags: np.ndarray, least: int) -> list[tuple[np.ndarray, ...]]:
    """(row, shortest prefix, longest prefix, count) of all prefixes counted ``least`` times or more.

    Rows are distinct and sorted, two words or more each. Prefixes of one path that have one count are one row. Counts
    of a hot node are parts of a sum over buckets: they come whatever they are, on their own.
    """
    n = len(high)
    if not n:
        return []
    new2 = np.concatenate([[True], high[1:] != high[:-1]])
    new3 = new2 | np.concatenate([[True], (low[1:] >> 32) != (low[:-1] >> 32)])
    has3, has4 = (low >> 32) > 0, (low & 0xFFFFFFFF) > 0
    node2, node3 = np.cumsum(new2) - 1, np.cumsum(new3) - 1
    f2 = np.add.reduceat(counts, np.flatnonzero(new2))[node2]
    f3 = np.add.reduceat(counts, np.flatnonzero(new3))[node3]
    hot2, hot3 = (flags & 1) > 0, (flags & 2) > 0
    same32 = has3 & (f3 == f2) & ~hot2 & ~hot3
    same43 = has4 & (counts == f3) & ~hot3
    found = [(np.flatnonzero(has4 & (counts >= least)), 4 - same43 - (same43 & same32), 4, counts)]
    taken3 = np.zeros(node3[-1] + 1, bool)
    taken3[node3[same43]] = True
    found.append((np.flatnonzero(new3 & has3 & (hot3 | (f3 >= least) & ~taken3[node3])), 3 - same32, 3, f3))
    taken2 = np.zeros(node2[-1] + 1, bool)
    taken2[node2[same32]] = True
    found.append((np.flatnonzero(new2 & (hot2 | (f2 >= least) & ~taken2[node2])), np.full(n, 2), 2, f2))
    return [(rows, lows[rows], np.full(len(rows), top), f[rows]) for rows, lows, top, f in found]


def _frequent(least: int):
    """Counts the grams of a bucket and language; a null phrase has the number of words."""
    def count(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        parts = [_unpack(b.as_buffer().to_pybytes()) for b in table.column("blob")]
        known: dict[bytes, int] = {}
        names: list[list[np.ndarray]] = [[], [], [], []]
        for words, numbers, _, _ in parts:
            local = np.array([0] + [known.setdefault(w, len(known) + 1) for w in words], np.int64)
            for column, own in zip(names, numbers, strict=True):
                column.append(local[own])
        high, low, counts, flags = counted([np.concatenate(c) for c in names], np.concatenate([p[2] for p in parts]),
                                           np.concatenate([p[3] for p in parts]))
        vocabulary = [b""] + list(known)
        edge = (high & 0xFFFFFFFF) > 0
        total = int(counts[~edge].sum())
        alone = np.flatnonzero(~edge & (counts >= least))
        phrases: list[str | None] = [None, *(vocabulary[w].decode() for w in high[alone] >> 32)]
        lows, highs, f = [np.array([0]), np.ones(len(alone), int)], [np.array([0]), np.ones(len(alone), int)], [[total], counts[alone]]
        high, low, counts, flags = high[edge], low[edge], counts[edge], flags[edge]
        for rows, short, long, n in paths(high, low, counts, flags, least):
            size = int(long[0]) if len(long) else 0
            codes = [(high[rows] >> 32), high[rows] & 0xFFFFFFFF, low[rows] >> 32, low[rows] & 0xFFFFFFFF][:size]
            phrases += [b" ".join([vocabulary[c] for c in gram]).decode() for gram in zip(*codes, strict=True)]
            lows.append(short)
            highs.append(long)
            f.append(n)
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()),
                         "low": pa.array(np.concatenate(lows).astype(np.int32)),
                         "high": pa.array(np.concatenate(highs).astype(np.int32)),
                         "f": pa.array(np.concatenate(f).astype(np.int64))})
    return count


def gram_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, text_col: str = "text", lang_col: str = "lang",
                bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, n), and (lang, words, phrase, f) of all grams of one to four words counted ``least`` times or more."""
    texts = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(col(text_col), F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    packed = packed_grams(texts, max(1, math.ceil(total / bucket_bytes)), hot_nodes(texts, total))
    rows = scratch.store(packed.groupBy("bucket", "lang").applyInArrow(_frequent(least), GRAMS), "paths")
    sizes = rows.filter("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    grams = (rows.filter("phrase IS NOT NULL")
             .select("lang", F.split("phrase", " ", -1).alias("path"), F.explode(F.sequence("low", "high")).alias("k"), "f")
             .select("lang", F.slice("path", 1, F.col("k")).alias("words"), "f")
             .groupBy("lang", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
             .select("lang", "words", F.array_join("words", " ").alias("phrase"), "f"))
    return sizes, scratch.store(grams, "grams")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT,
                 text_col: str = "text", lang_col: str = "lang", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to four words."""
    scratch = Scratch(docs.sparkSession, "phrases")
    sizes, grams = gram_counts(docs, scratch, least, text_col, lang_col, bucket_bytes)
    candidates = grams.filter(F.size("words") > 1)
    size = F.size("words")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, size), " ").alias("rest"))
    part = grams.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    cuts = (cuts.join(part, ["lang", "first"])
            .join(part.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
            .withColumn("score", F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)")))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # contiguous parts of two words or more of longer candidates
    inner = (candidates.filter(size > 2)
             .select("lang", "words", "f", F.explode(F.expr(
                 "flatten(transform(sequence(2, size(words) - 1), s -> transform(sequence(1, size(words) - s + 1), "
                 "b -> array_join(slice(words, b, s), ' '))))")).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    out = scratch.store(ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"),
                        "best", result=True)
    scratch.clear()
    return out
