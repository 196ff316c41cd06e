"""Ranked lexical search: documents are scanned with an Aho-Corasick automaton of all items' terms.

Terms are runs of ASCII letters and digits and of any characters beyond ASCII, A-Z lower-cased. In a scanned text every
other character becomes a blank, so the automaton's patterns are terms between two guarding blanks: a match is a whole
term, and neighbouring matches share a blank. A match adds one to its term's count in its document; no index of
the documents is made, only the counts of the items' own terms are stored between the two passes (the scan, which also
gives the corpus statistics, and the ranking). For the ranking a term's output is the list of its items.

The automaton and the lists are broadcast. They depend on the items alone, which are a stated query set; more than
``block_terms`` (item, term) pairs are taken in blocks of whole items of about that size, each scanning all documents, so
a broadcast is bounded whatever the number of items (only a single item's own text can pass the bound). A task keeps its
best ``k`` documents of each item; those are merged by item and salt, then by item.

A term's weight is ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and an item's score the sum over its distinct terms of
``weight * ((10^9 tf) div (1000 tf + 8 m))``, with ``m = 10 + (90 n N) div L``, in 64-bit integers.

Cases: null and empty texts, and texts without a term, are no documents of the statistics and are never listed; an item
without terms, or whose terms no document holds, has no rows; rows that repeat an item id are one item with the terms of
all of them, the null id included; rows that repeat a document id are documents of their own; equal scores go to the
smaller document id, a null id last; an empty table on either side gives an empty result; other columns are not looked at.
Documents of any length are scanned whole.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 10
BLOCK_TERMS = 500_000
SALTS = 64
CHUNK = 2_000_000  # (document, item) pairs or scores held at a time
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed value: a term is a run of anything but these ASCII characters
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# UTF-8 bytes: ASCII letters and digits and all bytes beyond ASCII stay, the rest are blanks
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))

COUNTS = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item int, doc_id long, score long"


def terms_of(text: Column) -> Column:
    """Array of a text's terms, repeats included; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once."""
    return items.select(col(id_col).alias("item_id"), F.explode(terms_of(col(text_col))).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Matches of " term " give the term's number."""
    found = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        found.add_word(f" {term} ", number)
    found.make_automaton()
    return found


def count_terms(texts: list[str], machine: ahocorasick.Automaton, n_terms: int) -> tuple[np.ndarray, ...]:
    """Terms per text, and (text, term, tf) of the machine's terms by text and term."""
    raw = (" " + " ".join(texts) + " ").encode("utf-8", "surrogatepass").translate(_FOLD)
    flat = np.frombuffer(raw, np.uint8) != 32
    begins = np.flatnonzero(flat[1:] & ~flat[:-1])  # the blank before a term
    edges = np.cumsum([0] + [len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    n = np.diff(np.searchsorted(begins, edges))
    pairs = np.fromiter(itertools.chain.from_iterable(machine.iter(raw.decode("utf-8", "surrogatepass"))), np.int64)
    ends, terms = pairs[::2], pairs[1::2]
    letters = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(letters, ends, side="left") - 1  # a match ends at the blank after its term
    keys, tf = np.unique(text * max(1, n_terms) + terms, return_counts=True)
    return n, keys // max(1, n_terms), keys % max(1, n_terms), tf


def scan(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with a term: its number of terms, and the numbers and counts of those in ``terms``."""
    if not terms:  # the machine cannot be empty; this word has no guarding blanks, so it fits no text
        machine = ahocorasick.Automaton()
        machine.add_word("\x00", 0)
        machine.make_automaton()
    else:
        machine = automaton(terms)
    shared, n_terms = docs.sparkSession.sparkContext.broadcast(machine), len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, text, term, tf = count_terms([t or "" for t in batch.column(1).to_pylist()], shared.value, n_terms)
            offsets = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (term.astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists],
                                             ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(count, COUNTS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _norms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    if int(n.max(initial=0)) * 90 * n_docs < 2**63:
        return 10 + (90 * n * n_docs) // total
    return np.array([10 + (90 * int(x) * n_docs) // total for x in n], np.int64)


class Best:
    """The k best (score, doc_id) of each item so far; equal scores go to smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item, score, doc, null) -> None:
        good = score >= self.least[item]
        item, score, doc, null = (np.concatenate([old, new[good]]) for old, new in (
            (self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        best = rank < self.k
        self.item, self.score, self.doc, self.null = item[best], score[best], doc[best], null[best]


def scores(n: np.ndarray, text: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, first: np.ndarray,
           items: np.ndarray, n_items: int, n_docs: int, total: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, score) of scores above 0, in chunks of texts; ``items[first[t]:first[t + 1]]`` are term t's items."""
    points = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * _norms(n, n_docs, total)[text]))
    fan = first[term + 1] - first[term]
    before = np.concatenate([[0], np.cumsum(fan)])
    upto = before[np.searchsorted(text, np.arange(len(n) + 1))]  # pairs before each text
    low, rows = 0, max(1, CHUNK // max(1, n_items))
    while low < len(n):
        high = max(low + 1, min(low + rows, int(np.searchsorted(upto, upto[low] + CHUNK, side="right")) - 1, len(n)))
        a, b = np.searchsorted(text, [low, high])
        at = np.repeat(np.arange(a, b), fan[a:b])
        which = items[np.arange(len(at)) - (before[at] - before[a]) + first[term[at]]]
        sums = np.zeros((high - low) * n_items, np.int64)
        np.add.at(sums, (text[at] - low) * n_items + which, points[at])
        hit = np.flatnonzero(sums > 0)
        yield hit // n_items + low, hit % n_items, sums[hit]
        low = high


def _ranked(counts: DataFrame, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, n_docs: int,
            total: int, k: int) -> DataFrame:
    """Each task's best ``k`` documents of every item."""
    tables = counts.sparkSession.sparkContext.broadcast((weights, first, items))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k)
        for batch in batches:
            null = np.array(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0))
            offsets = np.asarray(batch.column(2).offsets)
            text = np.repeat(np.arange(len(ids)), np.diff(offsets))
            term, tf = (np.asarray(batch.column(c).flatten()) for c in (2, 3))
            for at, item, score in scores(np.asarray(batch.column(1)), text, term, tf, *tables.value, n_items, n_docs, total):
                best.add(item, score, ids[at], null[at])
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.doc, mask=best.null),
                                          pa.array(best.score)], ["item", "doc_id", "score"])

    return counts.mapInArrow(rank, FOUND)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "automaton")
    pairs = scratch.store(item_terms(items, item_col, item_text_col), "pairs")
    kind = pairs.schema["item_id"].dataType
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    outs = []
    for number in range(blocks):
        held = pairs.filter(block == number).orderBy("item_id", "term").toArrow()  # bounded by block_terms
        names, at, which = np.unique(_codes(held.column("item_id")), return_index=True, return_inverse=True)
        owners = held.column("item_id").take(pa.array(at)).to_pylist()
        terms, number_of = np.unique(np.array(held.column("term").to_pylist(), object), return_inverse=True)
        counts = scratch.store(scan(docs, terms.tolist(), id_col, text_col), f"counts{number}")
        n_docs, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        dfs = np.zeros(len(terms), np.int64)
        for term, df in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # block's terms
            dfs[term] = df
        order = np.argsort(number_of, kind="stable")
        first = np.searchsorted(number_of[order], np.arange(len(terms) + 1))
        weights = np.array([weight(n_docs, int(df)) for df in dfs], np.int64)
        found = _ranked(counts, weights, first, which[order], len(names), n_docs, max(1, total), k)
        found = _top(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), ["item", "salt"], k)
        found = _top(found.drop("rank"), ["item"], k)
        owner = spark.createDataFrame([(i, o) for i, o in enumerate(owners)],
                                      f"item int, item_id {kind.simpleString()}")
        outs.append(scratch.store(found.join(owner, "item").select("item_id", "rank", "doc_id", "score"), f"best{number}",
                                  result=True))
    scratch.clear()
    out = outs[0]
    for other in outs[1:]:
        out = out.unionAll(other)
    return out


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers of equal values, nulls alike."""
    return np.asarray(values.combine_chunks().dictionary_encode(null_encoding="encode").indices)
