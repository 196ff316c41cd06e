"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is its multiset of five-word shingles (lower case, white space apart; shorter texts are one shingle). A
shingle weighs its count times 1 + ln(N / df) / ln(N / floor), between one and two times the count: document
frequencies of all documents are counted in a fixed table of hashed counters, whose mean load is the floor. The
sampling (Ioffe, 2010) draws SAMPLES weighted shingles per text; two texts draw the same one with the probability
of their weighted Jaccard similarity. Its random numbers come from fixed tables, addressed by two parts of a hash of
shingle and sample, so that there are 2 ** 32 combinations of them.

Texts that agree in a band of ROWS samples are compared with the band's centre: the member whose bands have the
most members in all, which in a family of copies is the common original. So a group of copies of any size makes one
pair per member. Every pair is verified on its texts: they are linked when the weighted Jaccard similarity, or the
plain one of the shingle sets (copies that fill much of a corpus make their own shingles common), is at least
THRESHOLD. Classes are the connected components of the links, and equal texts are one from the start.

Every two texts that agree in a band are covered: of one class, compared, or unlike by the triangle inequality (both
distances are metrics, so texts whose distances to a centre differ by more than 1 - THRESHOLD in both are unlike). A
band's members that a centre leaves open gather around new centres while that halves the open pairs; then all
pairs of different classes are compared, in blocks of bounded size, each pair in the first band it agrees in. That
part grows with the square of a family whose members are like each other in bands but not linked.

Of two texts 0.8 alike by weight all 16 bands miss with a chance below 0.0001; at a weighted 0.67 (the least that a
plain 0.8 gives where no shingle repeats) below 0.004. Counts weigh too: a text and its copy with one passage repeated
many times may be plainly alike but far apart by weight, share no band and not be compared. No band, group or partner
count is capped.

Cases: null and blank texts are alike to nothing, themselves included; texts of under five words are one shingle;
repeated rows are one text and one class; a class is named by its smallest non-null id; an empty table gives an
empty result; other columns are kept (``unique``) or not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, marked, salted_join

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
DF_BITS, POOL_BITS = 17, 16
BLOCK = 1 << 15  # shingles sampled at once
BLOCK_TEXTS, BLOCK_CHARS = 512, 4_000_000  # of a block that is compared with all others of its bucket; a text is sent once per block
FEW_OPEN = 128  # members of a bucket that are compared with each other without looking for another centre
CACHE_WORDS = 300_000
_U = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2 ** 63, n, dtype=np.uint64) * _U(2) + _U(1)


class Shingles:
    """Shingle hashes and counts of a text."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.mult = _odd(SHINGLE, 5)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        words = (text or "").lower().split()
        if not words:
            return None
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(one) < SHINGLE:
            one = np.concatenate([one, np.zeros(SHINGLE - len(one), np.uint64)])
        n = len(one) - SHINGLE + 1
        h = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            h += one[i:i + n] * self.mult[i]
            h ^= h >> _U(29)
        h *= self.mult[0]
        h ^= h >> _U(32)
        return np.unique(h, return_counts=True)


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[hashes >> _U(64 - DF_BITS)]


class Sampler:
    """SAMPLES consistent weighted samples of a weighted set, as BANDS hashes."""

    def __init__(self):
        rng = np.random.default_rng(2010)
        n = 1 << POOL_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n, dtype=np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.mult, self.mix = _odd(SAMPLES, 7)[:, None], _odd(ROWS, 11)

    def __call__(self, hashes: np.ndarray, w: np.ndarray) -> np.ndarray:
        best = np.full(SAMPLES, np.inf, np.float32)
        drawn = np.zeros(SAMPLES, np.uint64)
        rows = np.arange(SAMPLES)
        for low in range(0, len(hashes), BLOCK):
            h, ln_w = hashes[low:low + BLOCK], np.log(w[low:low + BLOCK]).astype(np.float32)
            product = h[None, :] * self.mult
            at = ((product >> _U(64 - 2 * POOL_BITS)) & _U((1 << POOL_BITS) - 1)).astype(np.int32)
            r, beta = self.r.take(at), self.beta.take(at)
            t = self.inverse.take(at)
            t *= ln_w
            t += beta
            np.floor(t, out=t)
            # ln a = ln c - r * (t - beta) - r
            beta -= t
            beta -= 1
            beta *= r
            beta += self.ln_c.take((product >> _U(64 - POOL_BITS)).astype(np.int32))
            k = beta.argmin(axis=1)
            least, steps = beta[rows, k], t[rows, k].astype(np.int64).astype(np.uint64)
            new = least < best
            best[new] = least[new]
            drawn[new] = (h[k] ^ (steps * _U(0x9E3779B97F4A7C15)))[new]
        drawn ^= drawn >> _U(31)
        bands = (drawn.reshape(BANDS, ROWS) * self.mix).sum(axis=1, dtype=np.uint64)
        return (bands ^ (bands >> _U(32))).view(np.int64)


def _idf(docs: DataFrame) -> np.ndarray:
    """Weight factors by hashed counter, from the document frequencies of all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total, n = Shingles(), np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (found := shingles(text)) is not None:
                    n += 1
                    np.add.at(total, (found[0] >> _U(64 - DF_BITS)).view(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["slot", "n"])

    rows = docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = int(rows.loc[rows.slot == -1, "n"].sum())
    rows = rows[rows.slot >= 0]
    df = np.zeros(1 << DF_BITS)
    df[rows.slot.to_numpy()] = rows.n.to_numpy()
    floor = max(1.0, df.mean())
    span = np.log(n / floor) if n > floor else 0.0
    idf = np.full(1 << DF_BITS, 2.0) if span <= 0 else 1 + np.clip(np.log(n / np.maximum(df, floor)) / span, 0, 1)
    return idf


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _own(row_id: Column) -> Column:
    """An id as a text that is never null."""
    return F.coalesce(row_id.cast("long").cast("string"), F.lit("null"))


def _banded(docs: DataFrame, id_col: str, text_col: str, table) -> DataFrame:
    """(id, key, bands): null bands for texts without words."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, draw, idf = Shingles(), Sampler(), table.value
        for batch in batches:
            bands = []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                bands.append(None if found is None else draw(found[0], weights(*found, idf)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))],
                                             ["id", "key", "bands"])

    rows = docs.select(col(id_col).cast("long").alias("id"), text_key(col(text_col)).alias("key"), col(text_col).alias("text"))
    return rows.mapInArrow(sample, "id long, key binary, bands array<long>")


def _centred(buckets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(bucket, key) -> buckets of two or more with their centre: bucket, key, centre.

    Most buckets have one member: a semi join, whose large side Spark can split, drops these before the rest is dealt.
    """
    sizes = scratch.store(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), f"{name}-sizes")
    shared = scratch.store(buckets.join(sizes, "bucket", "left_semi"), f"{name}-shared")
    members = scratch.store(salted_join(shared, sizes, "bucket", F.xxhash64("key")), f"{name}-members")
    weight = members.groupBy("key").agg(F.sum("n").alias("weight"))
    members = scratch.store(members.join(weight, "key"), f"{name}-weighed")
    centres = members.groupBy("bucket").agg(F.max_by("key", F.struct("weight", "key")).alias("centre"))
    return scratch.store(salted_join(members.select("bucket", "key"), centres, "bucket", F.xxhash64("key")), f"{name}-centred")


def _verified(pairs: DataFrame, texts: DataFrame, table, scratch: Scratch, name: str) -> DataFrame:
    """(centre, key) -> centre, key, weighted, plain: the similarities of their whole texts."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, idf, last = Shingles(), table.value, (None, None)

        def weighed(text):
            h, n = shingles(text)
            return h, weights(h, n, idf)

        for batch in batches:
            out, plain = [], []
            for one, other, centre in zip(batch.column("text").to_pylist(), batch.column("centre_text").to_pylist(),
                                          batch.column("centre").to_pylist(), strict=True):
                if last[0] != centre:
                    last = (centre, weighed(other))
                (h, w), (g, v) = weighed(one), last[1]
                both, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                common = np.minimum(w[i], v[j]).sum()
                out.append(common / (w.sum() + v.sum() - common))
                plain.append(len(both) / (len(h) + len(g) - len(both)))
            yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("key"), pa.array(out, pa.float64()),
                                              pa.array(plain, pa.float64())], ["centre", "key", "weighted", "plain"])

    # texts lie in buckets by key, so pairs move to them; no broadcast that only a small corpus would allow
    pairs = scratch.store(pairs.join(texts.select("key", "text").hint("merge"), "key"), f"{name}-left")
    right = texts.select(F.col("key").alias("centre"), F.col("text").alias("centre_text"))
    both = salted_join(pairs, right, "centre", F.xxhash64("key"), hint="merge")
    return scratch.store(both.mapInArrow(compare, "centre binary, key binary, weighted double, plain double"), f"{name}-verified")


def _uncovered(members: DataFrame, seen: DataFrame, roots: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(bucket, key, centre), similarities to the centres, (key, root) -> bucket, key, root of the members that may
    have a partner in their bucket which is of another class and which they were not compared with.

    A member of the centre's class may only have one if, in either similarity, the most similar member of another
    class is within 1 - threshold of it.
    """
    told = members.join(seen, ["centre", "key"], "left").join(roots, "key", "left").select(
        "bucket", "key", "centre", F.coalesce("root", "key").alias("root"), "weighted", "plain")
    told = scratch.store(told, "told")
    own = told.filter("key = centre").select("bucket", F.col("root").alias("own"))
    told = scratch.store(salted_join(told, own, "bucket", F.xxhash64("key")).filter("key <> centre"), "owned")
    others = told.filter("root <> own").groupBy("bucket").agg(F.max("weighted").alias("w"), F.max("plain").alias("p"))
    reach = 1 - threshold + 1e-9
    left = salted_join(told, others, "bucket", F.xxhash64("key")).filter(
        (F.col("root") != F.col("own")) | (F.col("weighted") <= F.col("w") + reach) | (F.col("plain") <= F.col("p") + reach))
    left = scratch.store(left.select("bucket", "key", "root"), "reached")
    mixed = left.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return scratch.store(left.join(scratch.store(mixed.select("bucket"), "mixed"), "bucket", "left_semi"), "left")


def _all_pairs(left: DataFrame, places: DataFrame, texts: DataFrame, table, threshold: float, scratch: Scratch) -> DataFrame:
    """(bucket, key, root) -> the links (a, b) between members of different classes that meet in a bucket.

    Members are dealt to blocks, and every two blocks of a bucket are a group, so that a bucket of any size is many
    small tasks. ``places`` has every text's buckets: a pair is compared in the first one it agrees in.
    """
    def links_of(rows: pa.Table) -> pa.Table:
        bucket, lo, hi = (rows.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
        keys, block = rows.column("key").to_pylist(), rows.column("block").to_numpy()
        root = np.unique(np.array([r.hex() for r in rows.column("root").to_pylist()]), return_inverse=True)[1]
        place = np.array(rows.column("places").to_pylist(), np.int64)
        first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        out = []
        if len(first) and len(second):
            same = place[first][:, None, :] == place[second][None, :, :]
            met = np.take_along_axis(place[first], same.argmax(axis=2), axis=1) == bucket
            met &= root[first][:, None] != root[second][None, :]
            if lo == hi:
                met &= first[:, None] < second[None, :]
            shingles = Shingles()
            sets = [shingles(t) for t in rows.column("text").to_pylist()]
            starts = np.cumsum([0] + [len(h) for h, _ in sets])
            hashes, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
            w = weights(hashes[at], np.concatenate([n for _, n in sets]), table.value)
            n, total = np.diff(starts), np.add.reduceat(w, starts[:-1])
            dense = np.zeros(len(hashes))
            for i in np.flatnonzero(met.any(axis=1)):
                one = first[i]
                mine = slice(starts[one], starts[one + 1])
                dense[at[mine]] = w[mine]
                held = dense[at]
                common, both = np.add.reduceat(np.minimum(held, w), starts[:-1]), np.add.reduceat((held > 0).astype(np.int64), starts[:-1])
                dense[at[mine]] = 0
                alike = np.maximum(common / (total + total[one] - common), both / (n + n[one] - both))
                out += [(keys[one], keys[j]) for j in second[met[i]] if alike[j] >= threshold]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    # rows are dealt without their texts, which join them last
    slim = scratch.store(left.join(places, "key").join(texts.select("key", "chars").hint("merge"), "key"), "open")
    sizes = slim.groupBy("bucket").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks"))
    dealt = salted_join(slim, scratch.store(sizes, "blocks"), "bucket", F.xxhash64("key")).withColumn(
        "block", F.pmod(F.xxhash64("key", "bucket"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "root", "places")
    dealt = scratch.store(dealt, "dealt").join(texts.select("key", "text").hint("merge"), "key")
    return scratch.store(dealt.groupBy("bucket", "lo", "hi").applyInArrow(links_of, "a binary, b binary"), "more")


def _components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (key, root): every linked key and the smallest key of its component.

    Rounds of hash-to-minimum with pointers followed once per round, until nothing changes; the number of rounds
    grows with the logarithm of a component's width. Only a counter reaches the driver.
    """
    edges = scratch.store(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = scratch.store(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select(
        "key", F.least("key", "m").alias("root")), "roots")
    rounds = 0
    while True:
        rounds += 1
        known = roots.select(F.col("key").alias("b"), F.col("root").alias("near"))
        offered = salted_join(edges, known, "b", F.xxhash64("a")).groupBy(F.col("a").alias("key")).agg(F.min("near").alias("near"))
        step = scratch.store(roots.join(offered, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root")), f"step{rounds}")
        jump = step.select(F.col("key").alias("root"), F.col("root").alias("far"))
        new = salted_join(step, jump, "root", F.xxhash64("key")).select("key", "old", F.least("root", "far").alias("root"))
        new = scratch.store(new, f"roots{rounds}")
        if not new.filter("root <> old").limit(1).count():
            return new.select("key", "root")
        roots = new.select("key", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, text_key, class_id (smallest id of its class), class_key (the text that has that id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    table = spark.sparkContext.broadcast(_idf(docs.select(col(text_col).alias("text"))))
    rows = scratch.store(_banded(docs, id_col, text_col, table), "banded", result=True)
    # equal texts have equal bands: any of them stands for all
    texts = scratch.store(rows.filter("bands IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands")), "texts")
    places = texts.select("key", F.transform("bands", lambda band, i: F.xxhash64(i, band)).alias("places"))
    buckets = scratch.store(places.select("key", F.explode("places").alias("bucket")), "buckets")
    members = _centred(buckets, scratch, "bands")
    # of equal texts the one with the smallest id is fetched, so that the copies of a text do not meet
    needed = members.select("key").distinct().join(texts.select("key", "id"), "key")
    needed = scratch.store(needed.select("key", _own(F.col("id")).alias("own")), "needed")
    whole = docs.select(text_key(col(text_col)).alias("key"), _own(col(id_col)).alias("own"), col(text_col).alias("text"))
    bodies = marked(whole, [F.col("key"), F.col("own")], needed, scratch, "needed").filter("_marked").drop("_marked")
    bodies = bodies.join(needed.hint("merge"), ["key", "own"], "left_semi").dropDuplicates(["key", "own"])
    # in buckets: every round fetches the texts of its own pairs, and the others stay where they are
    bodies = scratch.bucketed(bodies.select("key", "text", F.length("text").alias("chars")), "bodies", "key")
    alike = F.greatest("weighted", "plain") >= threshold
    seen, before = None, float("inf")
    while True:
        pairs = members.filter("key <> centre").select("centre", "key").distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["centre", "key"], "left_anti")
        found = _verified(pairs, bodies, table, scratch, "round")
        seen = found if seen is None else seen.union(found)
        links = seen.filter(alike).select(F.col("centre").alias("a"), F.col("key").alias("b"))
        roots = _components(links, scratch)
        left = _uncovered(members, seen, roots, threshold, scratch)
        most, open_ = left.groupBy("bucket").agg(F.count("*").cast("double").alias("n")).agg(F.max("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not most or most <= FEW_OPEN or open_ > before / 2:
            break
        members, before = _centred(left.select("bucket", "key"), scratch, "open"), open_
    if most:
        more = _all_pairs(left, places, bodies, table, threshold, scratch)
        if more.limit(1).count():
            roots = _components(links.union(more), scratch)
    classed = scratch.store(texts.select("key", "id").join(roots, "key", "left").select(
        "key", "id", F.coalesce("root", "key").alias("root")), "classed")
    names = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("m"), F.count("*").alias("n_texts")).select(
        "root", F.col("m.id").alias("class_id"), F.col("m.key").alias("class_key"), "n_texts")
    named = scratch.store(salted_join(classed.select("key", "root"), names, "root", F.xxhash64("key")).drop("root"), "named", result=True)
    scratch.clear()
    hexed = F.lower(F.hex("key")).alias("text_key")
    worded, wordless = rows.filter("bands IS NOT NULL"), rows.filter("bands IS NULL")
    return salted_join(worded.select("id", "key"), named, "key", F.xxhash64("id")).select(
        F.col("id").alias(id_col), hexed, "class_id", F.lower(F.hex("class_key")).alias("class_key"), "n_texts").unionByName(
        wordless.select(F.col("id").alias(id_col), hexed, F.col("id").alias("class_id"),
                        F.lower(F.hex("key")).alias("class_key"), F.lit(1).cast("long").alias("n_texts")))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, the one with the smallest id, all columns kept; wordless documents all stay."""
    names = docs.columns
    found = near_duplicates(docs, id_col, text_col, **options)
    scratch = Scratch(docs.sparkSession, "unique")
    told = found.select(F.concat_ws(":", _own(F.col(id_col)), "text_key").alias("row_key"), (
        F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))).alias("keep"))
    told = told.groupBy("row_key").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    # a row that stays and has no copy of its own need not move
    moved = scratch.store(told.filter("NOT keep OR n > 1").select("row_key", "keep"), "moved", result=True)
    packed = docs.select(F.struct(*[col(c) for c in names]).alias("row"))
    key = F.concat_ws(":", _own(F.col("row")[id_col]), F.lower(F.hex(text_key(F.col("row")[text_col]))))
    packed = marked(packed.withColumn("row_key", key), [F.col("row_key")], moved.select("row_key"), scratch, "moved", result=True)
    rest = packed.filter("_marked").join(moved.filter("NOT keep"), "row_key", "left_anti").dropDuplicates(["row_key"])
    kept = packed.filter("NOT _marked").select("row").union(rest.select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in names])
