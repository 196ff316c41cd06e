"""Suffix dedup, phrase graph and automaton search against brute force, and on odd rows and tables."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sitetable.llm import automaton_search, phrase_graph, suffix_dedup

TINY = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


# --- repeated byte strings ---

def true_removals(docs, length=50):
    least, rows = {}, [(i, (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for p in range(len(b) - length + 1 if i is not None else 0):
            least[b[p:p + length]] = min(least.get(b[p:p + length], i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if least[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removals(df, **options):
    return sorted(map(tuple, suffix_dedup.digests(df, **options).collect()), key=repr)


def test_removed_bytes_of_the_table(tiny):
    assert removals(tiny) == true_removals([(r.doc_id, r.text) for r in tiny.collect()])


@pytest.mark.parametrize(("hot", "block"), [(1000, 1 << 20), (2, 1 << 20), (1000, 300), (2, 300)])
def test_removed_bytes_of_odd_rows(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot + block)
    base = "".join(rng.choice("ab é\n") for _ in range(400))
    rows = [(rng.choice([None, *range(-1, 7)]), "".join(base[(o := rng.randrange(300)):o + rng.randrange(100)]
                                                        for _ in range(rng.randrange(5)))) for _ in range(50)]
    rows += [(3, None), (4, ""), (5, "-" * 3000), (6, "-" * 700), (6, "-" * 700), (None, "-" * 99), (8, base), (9, base), (9, base)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, h string")
    out = suffix_dedup.repeated_spans(df, block_bytes=block, with_kept=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), r.kept_sha256) for r in out),
                  key=repr) == true_removals(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)


def test_passage_in_every_document_is_spread_and_removed(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(2)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(80))
    passage = noise()
    rows = [(i, noise() + passage + noise()) for i in range(60)]
    assert removals(spark.createDataFrame(rows, "doc_id long, text string")) == true_removals(rows)


def test_other_lengths_and_empty_tables(spark):
    rows = [(1, "0123456789" * 9), (2, "x" + "0123456789" * 4 + "y"), (3, "y" * 31)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removals(df, length=32) == true_removals(rows, 32)
    assert removals(df.limit(0)) == []
    assert removals(df.filter("doc_id = 3")) == true_removals(rows[2:])
    with pytest.raises(ValueError):
        suffix_dedup.digests(df, length=20)


def test_multikey_order_sorts_and_groups():
    rng = random.Random(7)
    raw = bytes(rng.choice(b"ab") for _ in range(900)) * 2 + bytes(8)
    starts = [i for i in range(1700)]
    order, new = suffix_dedup.multikey_order(raw, __import__("numpy").array(starts), 50)
    strings = [raw[s:s + 50] for s in order]
    assert strings == sorted(raw[s:s + 50] for s in starts)
    assert [bool(n) for n in new] == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


# --- phrases ---

def true_phrases(docs, least=30, top=2000):
    counts, n = {}, collections.Counter()
    for lang, text in docs:
        c = counts.setdefault(lang or "und" if lang is None else lang, collections.Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3, 4):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for b in range(len(p) - size + 1):
                    longer[p[b:b + size]] = max(longer[p[b:b + size]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] < 80 * a:
                score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrases(df, **options):
    return sorted(map(tuple, phrase_graph.collocations(df, **options).collect()))


def test_phrases_of_the_table(tiny):
    assert phrases(tiny, least=5) == true_phrases([(r.lang, r.text) for r in tiny.collect()], 5)


@pytest.mark.parametrize("hot", [64, 1])
@pytest.mark.parametrize(("least", "top"), [(1, 2000), (3, 2000), (4, 2)])
def test_phrases_of_odd_rows(spark, monkeypatch, hot, least, top):
    monkeypatch.setattr(phrase_graph, "HOT_COUNT", hot)
    rows = [("en", "a b c d a b c d. a b c\tA B, x"), (None, "q r s t q r s t"), ("und", "Q r"), ("en", None), ("en", ""),
            ("fr", "..;"), ("en", "a b c d e f g\x00 h"), ("", "é É ü é É ü"), ("en", "z " * 400)] * 3
    df = spark.createDataFrame([(lang, t, 1, 2) for lang, t in rows], "lang string, text string, f int, low int")
    expected = true_phrases(rows, least, top)
    assert phrases(df, least=least, top=top, bucket_bytes=20) == expected


def test_phrase_ties_and_empty_table(spark):
    df = spark.createDataFrame([("en", "b c. a d. é f. b c. a d. é f")], "lang string, text string")
    assert [r[2] for r in phrases(df, least=2)] == ["a d", "b c", "é f"]
    assert phrases(df.limit(0)) == []
    assert phrases(df, least=3) == []


def test_paths_stand_for_their_prefixes():
    np = __import__("numpy")
    high, low, counts, _ = phrase_graph.counted([np.array(c) for c in ([1, 1, 1, 5], [2, 2, 2, 6], [3, 3, 0, 7], [4, 4, 0, 0])],
                                                np.array([2, 3, 1, 4]))
    found = {(int(r), int(a), int(b), int(f)) for p in phrase_graph.paths(high, low, counts, np.zeros(3, np.uint8), 1)
             for r, a, b, f in zip(*p, strict=True)}
    assert found == {(0, 2, 2, 6), (1, 3, 4, 5), (2, 2, 3, 4)}


# --- ranked search ---

def true_search(docs, items, k=10):
    term = re.compile(automaton_search.TERM)
    held = [(i, term.findall((t or "").translate(FOLD))) for i, t in docs]
    held = [(i, collections.Counter(w), len(w)) for i, w in held if w]
    total, df = sum(n for _, _, n in held), collections.Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term.findall((t or "").translate(FOLD)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in held:
            m = 10 + (90 * n * len(held)) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(docs, items, **options):
    return sorted(map(tuple, automaton_search.search(docs, items, **options).collect()), key=repr)


@pytest.mark.parametrize("block", [500_000, 40])
def test_search_of_the_table(spark, tiny, block):
    items = spark.read.parquet(f"{TINY}/benchmark.parquet")
    expected = true_search([(r.doc_id, r.text) for r in tiny.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert searched(tiny, items, block_terms=block) == expected


@pytest.mark.parametrize("k", [2, 10])
def test_search_of_odd_rows(spark, monkeypatch, k):
    monkeypatch.setattr(automaton_search, "CHUNK", 7)
    docs = [(1, "A b-c é\x00漢字 a"), (2, "a a a b"), (2, "a a a b"), (3, None), (4, ""), (5, " -- "), (None, "b c"), (None, "b c"),
            (6, "b c"), (7, "É é a1 1a"), (8, "word " * 5000 + "b"), (9, "🙂 a 🙂🙂")]
    items = [(1, "A, b; c"), (1, "é"), (2, None), (3, ""), (4, "absent"), (None, "🙂 a"), (5, "--"), (6, "word word 1A 漢字")]
    ours = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, n int")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, term int")
    assert searched(ours, asked, k=k) == true_search(docs, items, k)
    assert searched(ours.limit(0), asked) == [] and searched(ours, asked.limit(0)) == []


def test_long_items_and_frequent_terms(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the "), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int"))).alias("text"))
    items = spark.createDataFrame([(1, "the w " + " ".join(f"x{i}" for i in range(2000)))], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert searched(docs, items) == true_search(rows, [(1, items.first().text)])
