"""Removal of repeated byte strings with a sparse suffix array in range buckets.

A byte of a document goes when a string of ``length`` bytes over it also starts in a document with a smaller id; strings
are judged on the input. All suffixes of a corpus are far more than a cluster can move, so they are thinned exactly:

1. Exact copies go to their smallest id: a batch drops those it has seen, and a block of texts (by hash) the rest.
2. The ``length`` bytes at a position have an anchor, the 16-byte token of least hash in them. Equal strings have equal
   anchors, and some 18 positions in a row share theirs. A block sends its distinct anchors once; those of one
   document only cannot begin a repeat, and their suffixes are left out (exact: hashes can only leave too many in).
3. The suffixes that remain travel as segments, the bytes of all suffixes that share an anchor in a row, each
   once per block with the least and greatest id that hold it. Splitters sampled from the blocks' anchor tokens
   range-partition them by leading token. Segments of an anchor in ``HOT`` documents or more travel as single suffixes,
   dealt by a hash of all their bytes, so a passage in a third of all documents is no bucket of its own.
4. A bucket sorts its suffixes by multikey quicksort, eight bytes a step and only ties go on, and gives each the least id
   of its equals. Equal suffixes share a leading token, hence a bucket; its neighbours need no look.
5. A block marks what its documents lose, and copies of a text take its result.

Every group in memory is a block (``block_bytes`` of text and one text at most) or a bucket, which is less.

Cases: a null text is empty; texts shorter than ``length`` keep all; rows with a null id are nobody's smaller document and
lose nothing; rows that repeat an id are not each other's smaller document; a copy of a text under a greater id loses all its
bytes (when ``length`` or more); repeats within one document stay; an empty table gives an empty result; other
columns are not looked at; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, TOKEN = 50, 16
BLOCK_BYTES = 8 << 20
BUCKETS_PER_BLOCK = 4  # a segment is some four times the bytes that begin a suffix in it, and sorting needs room
HOT = 1000
CHUNK = 1 << 17  # positions whose hashes are held at a time
LONGEST = 64  # suffixes of a segment
SAMPLE_TEXTS, SAMPLE_BYTES = 512, 4096  # for the splitters, which settle balance only
SEEN = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TEXTS = "block int, h binary, id long, text binary"
MOVED = "bucket int, block int, kind int, blob binary"
RESULT = "h binary, id long, starts array<long>, ends array<long>, kept binary, kept_sha256 string"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte integers, compressed."""
    body = b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *[a.astype("<i8").tobytes() for a in arrays]])
    return np.array([len(arrays), len(body)], "<i8").tobytes() + pa.Codec("zstd", 1).compress(body, asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    body = pa.Codec("zstd").decompress(blob[16:], size, asbytes=True)
    sizes = np.frombuffer(body, "<i8", n)
    edges = 8 * (n + np.concatenate([[0], np.cumsum(sizes)]))
    return [np.frombuffer(body, "<i8", int(s), int(e)) for s, e in zip(sizes, edges, strict=False)]


def _words(raw: bytes, n: int, offset: int = 0, order: str = "<") -> np.ndarray:
    """The eight bytes from every position on, as integers; a view."""
    return np.ndarray((n,), f"{order}u8", raw, offset, (1,))


class Block:
    """Texts side by side, each at least ``length`` bytes; zeros follow the last."""

    def __init__(self, table: pa.Table, length: int):
        rows: dict[bytes, tuple[int, bytes]] = {}
        for h, i, text in zip(table.column("h").to_pylist(), table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True):
            if h not in rows or i < rows[h][0]:
                rows[h] = (i, text)
        self.keys = sorted(rows)
        self.ids = np.array([rows[h][0] for h in self.keys], np.int64)
        self.texts = [rows[h][1] for h in self.keys]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.raw = b"".join([*self.texts, bytes(length + 64)])
        self.size, self.length = int(self.ends[-1]), length

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First position, number of positions and anchor of each run of positions whose strings share an anchor."""
        window = self.length - TOKEN + 1
        stop = np.zeros(self.size + 1, np.int8)  # 1 where a text ends too soon for a string
        np.add.at(stop, self.ends - self.length + 1, 1)
        np.add.at(stop, self.ends, -1)
        valid = np.cumsum(stop[:-1], dtype=np.int8) == 0
        out: list[list[np.ndarray]] = [[], [], []]
        for low in range(0, self.size, CHUNK):
            n = min(CHUNK, self.size - low)
            h = _words(self.raw, n + window - 1, low) * _A
            h ^= _words(self.raw, n + window - 1, low + 8) * _B
            h ^= h >> np.uint64(29)
            h *= _C
            h ^= h >> np.uint64(32)
            width = 1
            while width < window:  # least hash of ever wider windows
                step = min(width, window - width)
                h = np.minimum(h[:-step], h[step:])
                width += step
            ok = valid[low:low + n]
            new = np.ones(n, bool)
            new[1:] = (h[1:] != h[:-1]) | ~ok[:-1]
            first = np.flatnonzero(new & ok)
            upto = np.concatenate([[0], np.cumsum(ok)])
            count = np.diff(np.append(upto[first], upto[-1]))
            for values, v in zip(out, (first + low, count, h[first]), strict=True):
                values.append(v)
        start, count, anchor = (np.concatenate(v) for v in out)
        pieces = -(-count // LONGEST)
        at = np.repeat(np.arange(len(start)), pieces)
        number = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return start[at] + number * LONGEST, np.minimum(count[at] - number * LONGEST, LONGEST), anchor[at]

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")

    def begin_of(self, text: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], self.ends])[text]


def _filter_key(anchor: np.ndarray) -> np.ndarray:
    """48 bits of an anchor: enough to tell which are shared, and to deal them out."""
    return (anchor >> np.uint64(16)).astype(np.int64)


def _anchor_counts(length: int, buckets: int):
    """A block's distinct anchors with the number of texts that have them, by bucket."""
    def send(table: pa.Table) -> pa.Table:
        block = Block(table, length)
        start, _, anchor = block.runs()
        key, text = _filter_key(anchor), block.text_of(start)
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        other = new | np.concatenate([[True], text[1:] != text[:-1]])
        at = np.flatnonzero(new)
        counts, key = np.add.reduceat(other.astype(np.int64), at), key[at]
        bucket = (key * buckets) >> 48
        which, begins = np.unique(bucket, return_index=True)
        blobs = [_packed(np.diff(k, prepend=0), c) for k, c in zip(np.split(key, begins[1:]), np.split(counts, begins[1:]), strict=True)]
        return _moved(which, table.column("block")[0].as_py(), 0, blobs)
    return send


def _moved(bucket, block, kind: int, blobs: list[bytes]) -> pa.Table:
    n = len(blobs)
    block = np.broadcast_to(np.asarray(block, np.int32), n)
    return pa.table({"bucket": pa.array(np.asarray(bucket).astype(np.int32)), "block": pa.array(block),
                     "kind": pa.array(np.full(n, kind, np.int32)), "blob": pa.array(blobs, pa.binary())})


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Tells each block which of its anchors two texts or more have, and which are hot."""
    parts = [_unpacked(b) for b in table.column("blob").to_pylist()]
    keys = [np.cumsum(p[0]) for p in parts]
    key, counts = np.concatenate(keys), np.concatenate([p[1] for p in parts])
    distinct, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)[at]  # sums below 2^53 are exact
    word = np.where(total >= 2, key * 2 + (total >= HOT), -1)
    replies = [w[w >= 0] for w in np.split(word, np.cumsum([len(k) for k in keys])[:-1])]
    some = [(b, w) for b, w in zip(table.column("block").to_pylist(), replies, strict=True) if len(w)]
    return _moved(np.zeros(len(some)), [b for b, _ in some], 1, [_packed(w) for _, w in some])


def _segments(length: int, buckets: int, splitters: np.ndarray):
    """Sends a block's repeated segments to buckets, and where they are to the block's later self."""
    def send(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows or not replies.num_rows:
            return _moved([], [], 2, [])
        block, number = Block(texts, length), texts.column("block")[0].as_py()
        shared = np.sort(np.concatenate([_unpacked(b)[0] for b in replies.column("blob").to_pylist()]))
        start, count, anchor = block.runs()
        key = _filter_key(anchor)
        at = np.minimum(np.searchsorted(shared >> 1, key), len(shared) - 1)
        kept = np.flatnonzero((shared >> 1)[at] == key)
        hot = (shared[at[kept]] & 1) > 0
        start, count = start[kept], count[kept]
        tokens = _leading_tokens(block, start, anchor[kept])
        bucket = np.searchsorted(splitters, tokens) if len(splitters) else np.zeros(len(start), np.int64)
        fan = np.where(hot, count, 1)  # hot segments become single suffixes
        source = np.repeat(np.arange(len(start)), fan)
        step = np.arange(len(source)) - np.repeat(np.cumsum(fan) - fan, fan)
        start, size, bucket, hot = start[source] + step, np.where(hot, 1, count)[source] + length - 1, bucket[source], hot[source]
        text, raw = block.text_of(start), block.raw
        known: dict[bytes, int] = {}
        entry = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)),
                            np.int64, len(start))
        order = np.lexsort((block.ids[text], entry))
        first = np.searchsorted(entry[order], np.arange(len(known)))
        last = np.append(first[1:], len(order)) - 1
        head = order[first]
        least, greatest = block.ids[text[head]], block.ids[text[order[last]]]
        strings = list(known)
        place = bucket[head]
        for e in np.flatnonzero(hot[head]):
            place[e] = int.from_bytes(hashlib.blake2b(strings[e], digest_size=6).digest(), "little") % buckets
        by_place = np.argsort(place, kind="stable")
        which, begins = np.unique(place[by_place], return_index=True)
        blobs = [_send(strings, e, least, greatest) for e in np.split(by_place, begins[1:])]
        kept_here = _packed(entry[order], text[order], np.asarray(start[order] - block.begin_of(text[order])))
        return pa.concat_tables([_moved(which, number, 2, blobs), _moved([number % buckets], number, 3, [kept_here])])
    return send


def _leading_tokens(block: Block, start: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The 16 bytes at the anchor of the strings that start at ``start``."""
    out = np.zeros(len(start), f"S{TOKEN}")
    left = np.arange(len(start))
    for step in range(block.length - TOKEN + 1):
        if not len(left):
            break
        at = start[left] + step
        h = (_words(block.raw, block.size + block.length)[at] * _A) ^ (_words(block.raw, block.size + block.length, 8)[at] * _B)
        h ^= h >> np.uint64(29)
        h *= _C
        h ^= h >> np.uint64(32)
        hit = h == anchor[left]
        out[left[hit]] = np.ndarray((block.size + block.length,), f"S{TOKEN}", block.raw, 0, (1,))[at[hit]]
        left = left[~hit]
    return out


def _send(strings: list[bytes], entries: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> bytes:
    held = [strings[e] for e in entries.tolist()]
    data = b"".join(held)
    sizes = np.array([len(s) for s in held], np.int64)
    padded = data + bytes(-len(data) % 8)
    return _packed(entries, sizes, least[entries], greatest[entries], np.frombuffer(padded, "<i8"))


def multikey_order(raw: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``length`` bytes, and where another string begins in it.

    Eight bytes at a time: what these tell apart is placed, only ties are sorted by the next eight.
    """
    order, tied = np.arange(len(starts)), np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    new[:1] = True
    for offset in [*range(0, length - 8, 8), length - 8]:
        if not len(tied):
            break
        view = _words(raw, len(raw) - offset - 7, offset, ">")
        group = np.cumsum(new)[tied]
        word = view[starts[order[tied]]].astype(np.uint64)
        by = np.lexsort((word, group))
        order[tied] = order[tied][by]  # groups are in order already, so ties stay within their group's places
        word, group = word[by], group[by]
        new[tied[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
    return order, new


def _repeats(length: int):
    """Sorts a bucket's suffixes; tells each block the suffixes that a smaller id has too."""
    def sort(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        out = [table.filter(pa.array(kinds == 3)).select(["bucket", "block", "kind", "blob"])]
        sent = table.filter(pa.array(kinds == 2))
        if sent.num_rows:
            parts = [_unpacked(b) for b in sent.column("blob").to_pylist()]
            entry, size, least, greatest = (np.concatenate([p[c] for p in parts]) for c in range(4))
            owner = np.repeat(np.asarray(sent.column("block")), [len(p[0]) for p in parts])
            raw = b"".join([*(p[4].tobytes()[:int(p[1].sum())] for p in parts), bytes(8)])
            begin, fan = np.cumsum(size) - size, size - length + 1
            source = np.repeat(np.arange(len(size)), fan)
            step = np.arange(len(source)) - np.repeat(np.cumsum(fan) - fan, fan)
            order, new = multikey_order(raw, begin[source] + step, length)
            at = np.flatnonzero(new)
            lows = np.empty(len(order), np.int64)
            lows[order] = np.repeat(np.minimum.reduceat(least[source][order], at), np.diff(np.append(at, len(order))))
            hit = np.flatnonzero(lows < greatest[source])
            by = hit[np.argsort(owner[source[hit]], kind="stable")]
            which, begins = np.unique(owner[source[by]], return_index=True)
            if len(by):
                out.append(_moved(np.zeros(len(which)), which, 4, [
                    _packed(entry[source[p]], step[p], lows[p]) for p in np.split(by, begins[1:])]))
        return pa.concat_tables([t.cast(_moved([], [], 0, []).schema) for t in out])
    return sort


def _marked(length: int, with_kept: bool):
    """Spans and kept bytes of a block's texts."""
    def mark(texts: pa.Table, moved: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _results([], [], [], [], [], [])
        block = Block(texts, length)
        kinds = moved.column("kind").to_pylist()
        blobs = [_unpacked(b) for b in moved.column("blob").to_pylist()]
        held = [p for k, p in zip(kinds, blobs, strict=True) if k == 3]
        hits = [p for k, p in zip(kinds, blobs, strict=True) if k == 4]
        change = np.zeros(block.size + 1, np.int32)
        if held and hits:
            entry, text, start = held[0]
            hit, step, low = (np.concatenate([p[c] for p in hits]) for c in range(3))
            first, last = np.searchsorted(entry, hit), np.searchsorted(entry, hit, side="right")
            fan = last - first
            source = np.repeat(np.arange(len(hit)), fan)
            at = first[source] + np.arange(len(source)) - np.repeat(np.cumsum(fan) - fan, fan)
            lost = low[source] < block.ids[text[at]]
            begin = (block.begin_of(text[at]) + start[at] + step[source])[lost]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        edges = np.concatenate([[0], block.ends])
        out: list[list] = [[], [], [], []]
        for number, text in enumerate(block.texts):
            own = gone[edges[number]:edges[number + 1]]
            flips = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            kept = np.frombuffer(text, np.uint8)[~own].tobytes() if len(flips) else text
            for values, v in zip(out, (flips[::2], flips[1::2], kept if with_kept else None, hashlib.sha256(kept).hexdigest()), strict=True):
                values.append(v)
        return _results(block.keys, block.ids, *out)
    return mark


def _results(keys, ids, starts, ends, kept, shas) -> pa.Table:
    longs = pa.list_(pa.int64())
    return pa.table([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array([list(map(int, s)) for s in starts], longs),
                     pa.array([list(map(int, s)) for s in ends], longs), pa.array(kept, pa.binary()), pa.array(shas, pa.string())],
                    names=["h", "id", "starts", "ends", "kept", "kept_sha256"])


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops a copy of a text that the task has seen under the same or a smaller id."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        if len(seen) > SEEN:
            seen.clear()
        keep = []
        for h, i in zip(batch.column("h").to_pylist(), batch.column("id").to_pylist(), strict=True):
            keep.append(i < seen.get(h, i + 1))
            if keep[-1]:
                seen[h] = i
        yield batch.filter(pa.array(keep, pa.bool_()))


def sampled_splitters(texts: DataFrame, buckets: int, length: int) -> np.ndarray:
    """Anchor tokens that cut those of a bounded sample of texts (in hash order) into ``buckets`` ranges."""
    rows = (texts.orderBy(F.xxhash64("h")).limit(SAMPLE_TEXTS)
            .select("h", "id", F.substring("text", 1, SAMPLE_BYTES).alias("text")).toArrow())
    if not rows.num_rows:
        return np.zeros(0, f"S{TOKEN}")
    block = Block(rows, length)
    start, _, anchor = block.runs()
    tokens = np.sort(_leading_tokens(block, start, anchor))
    return np.unique(tokens[np.linspace(0, len(tokens), buckets + 1)[1:-1].astype(int)])


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, starts, ends, kept (null unless ``with_kept``), kept_sha256 of every document.

    ``starts`` and ``ends`` are the removed byte runs. A kept text may be cut within a character; it is binary.
    """
    if length < 2 * TOKEN:
        raise ValueError(f"length must be {2 * TOKEN} or more")
    raw = F.coalesce(col(text_col), F.lit("")).cast("binary")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), raw.alias("text"))
    sizes = rows.select(F.octet_length("text").cast("long").alias("n"))
    blocks = max(1, math.ceil((sizes.filter(F.col("n") >= length).agg(F.sum("n")).first()[0] or 0) / block_bytes))
    h = F.md5("text")
    long = rows.filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    texts = long.select(F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int").alias("block"),
                        F.unhex(h).alias("h"), F.col("doc_id").alias("id"), "text")
    buckets = BUCKETS_PER_BLOCK * blocks
    splitters = sampled_splitters(texts, buckets, length)
    texts = texts.mapInArrow(_first_seen, TEXTS)
    by_block = texts.groupBy("block")
    counts = by_block.applyInArrow(_anchor_counts(length, blocks), MOVED)
    replies = counts.groupBy("bucket").applyInArrow(_shared_anchors, MOVED)
    sent = by_block.cogroup(replies.groupBy("block")).applyInArrow(_segments(length, buckets, splitters), MOVED)
    found = sent.groupBy("bucket").applyInArrow(_repeats(length), MOVED)
    marked = by_block.cogroup(found.groupBy("block")).applyInArrow(_marked(length, with_kept), RESULT)

    slim = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                       F.when((F.octet_length("text") >= length) & F.col("doc_id").isNotNull(), F.unhex(h)).alias("h"),
                       F.when((F.octet_length("text") < length) | F.col("doc_id").isNull(), F.sha2("text", 256)).alias("sha"),
                       F.when((F.octet_length("text") < length) | F.col("doc_id").isNull(), F.col("text")).alias("whole"))
    copy = F.col("doc_id") > F.col("id")
    none = F.array().cast("array<long>")
    return slim.join(marked, "h", "left").select(
        "doc_id", "n_bytes",
        F.when(F.col("id").isNull(), none).when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"),
        F.when(F.col("id").isNull(), none).when(copy, F.array("n_bytes")).otherwise(F.col("ends")).alias("ends"),
        (F.when(F.col("id").isNull(), F.col("whole")).when(copy, F.lit(b"")).otherwise(F.col("kept"))
         if with_kept else F.lit(None).cast("binary")).alias("kept"),
        F.when(F.col("id").isNull(), F.col("sha")).when(copy, F.lit(EMPTY_SHA)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spans = repeated_spans(docs, length, id_col, text_col)
    total = F.aggregate("starts", F.lit(0).cast("long"), lambda a, x: a - x)
    return spans.select("doc_id", "n_bytes", F.aggregate("ends", total, lambda a, x: a + x).alias("n_removed"),
                        F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
