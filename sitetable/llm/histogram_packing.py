"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents become token ids, an end id follows each, and longer ones are cut into pieces of at most ``size`` ids.
Only the histogram of piece lengths (``size`` numbers) reaches the driver. There lengths are placed from longest to
shortest: each time the group of equal packs with the most room (the shortest packs) takes the length, whole groups
at once, so a step handles all packs of a pattern by changing counts; what fits no pack opens new ones. A step uses
up a length or a group, so the number of patterns is bounded by the histogram, however many documents there are.
Each pattern place is a range of ranks of its length. Pieces get their rank within their length by counting, and a
binary search over the places (bounded by the histogram, broadcast) turns rank into sequence and offset.

Tokens are made by the tokenizers library per distinct word of a batch and joined by a look-up: the tokenizer drops
white space and never joins across it, so a text's ids are its words' ids (tested against whole texts).

Cases: null and empty texts give one piece, the end id; repeated rows and ids are packed as often as they come; an
empty table gives an empty result; other columns are not looked at; a document of any length is cut as it comes.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col

SIZE, END_ID = 2048, 1
CACHE_BYTES, ENTRY_BYTES, LONG_WORD = 96 << 20, 150, 64  # of a worker's known words; longer words are not kept
WORD_END = "</w>"
PIECES_PER_CHUNK = 20_000
MARKS = frozenset(".,")


def _blanks(text: str) -> str:
    # the tokenizer's own white space that str.split(" ") shall cut at; rarer kinds are left to the tokenizer
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


class WordIds:
    """Little-endian 32-bit ids of words, kept for the words seen last.

    Words are kept in two halves: once the newer is full it becomes the older, whose words return to the newer when
    they come again and else go with it. So frequent words stay, and the bytes kept are bounded.
    """

    def __init__(self, path: str):
        # Spark runs a task per core: threads of a task's own would only contend
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older, self.held = Tokenizer.from_file(path), {}, {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _coded(self, words: list[str]) -> list[bytes]:
        """Ids of words. A word has at least one id that ends a word, words of letters mostly one: these go as one text,
        and if there are as many such ids as words, each word's are told by them."""
        if words and words[0].isalpha():
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            last = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(last) == len(words):
                raw = ids.tobytes()
                return [raw[a:b] for a, b in zip([0, *last], last, strict=False)]
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that the newer half lacks; all but very long ones are kept there."""
        known, older = self.known, self.older
        new: dict[str, bytes] = {w: older[w] for w in words if w in older}
        cores = {w: _core(w) for w in words if w not in new}
        missing = {c for c, _ in cores.values()}.union(MARKS).difference(known, new)
        new.update([(c, older[c]) for c in missing if c in older])
        missing.difference_update(new)
        for part in ([w for w in missing if w.isalpha()], [w for w in missing if not w.isalpha()]):
            for at in range(0, len(part), 2000):
                new.update(zip(part[at:at + 2000], self._coded(part[at:at + 2000]), strict=True))
        both = _Either(new, known)
        new.update([(w, both[c] + both[mark] if mark else both[c]) for w, (c, mark) in cores.items()])
        kept = {w: b for w, b in new.items() if len(w) <= LONG_WORD}
        known.update(kept)
        self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
        return {w: b for w, b in new.items() if len(w) > LONG_WORD}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_blanks(t).split(" ") for t in texts]
        if self.held > CACHE_BYTES // 2:
            self.older, self.known, self.held = self.known, {}, 0
        known = self.known
        new = set().union(*split).difference(known)
        long = self._learn(new) if new else {}
        get = (known if not long else _Either(known, long)).__getitem__
        return [b"".join(map(get, words)) for words in split]


class _Either(dict):
    """Looks in one mapping, then in the other."""

    def __init__(self, first: dict, second: dict):
        super().__init__()
        self.first, self.second = first, second

    def __getitem__(self, key):
        found = self.first.get(key)
        return self.second[key] if found is None else found


def _core(word: str) -> tuple[str, str]:
    """A word with the same ids, and a sign after it that the tokenizer keeps apart: letters, then one sign.

    ASCII is looked up in lower case, as the tokenizer takes it; other letters' rules are left to the tokenizer.
    """
    mark = word[-1:] if word[-1:] in MARKS and word[:-1].isalpha() else ""
    core = word[:-1] if mark else word
    return core.lower() if core.isascii() and core.isalpha() else core, mark


class _Kept:
    """A worker process keeps its words from task to task, as it does the value of a broadcast.

    So they go as soon as the worker gets a task of another job, which needs the memory for its own work.
    """

    def __init__(self, path: str):
        self.path = path

    @functools.cached_property
    def ids(self) -> WordIds:
        return WordIds(self.path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
           end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()
    kept = docs.sparkSession.sparkContext.broadcast(_Kept(tokenizer_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept.value.ids
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            totals, sums = [], []
            for low in range(0, len(names), 256):
                for raw in ids.encode([t or "" for t in texts[low:low + 256]]):
                    raw += end
                    totals.append(len(raw) // 4)
                    view = memoryview(raw)
                    sums += [zlib.crc32(view[at:at + 4 * size]) for at in range(0, len(raw), 4 * size)]
            total = np.array(totals, np.int64)
            counts = -(-total // size)
            row = np.repeat(np.arange(len(total)), counts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(np.minimum(total[row] - start, size)),
                 pa.array(sums, pa.int64()), pa.array(total[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """length -> count becomes patterns: (number of packs, [(length, times in each pack)])."""
    room: dict[int, list[tuple[int, tuple]]] = {}  # free ids -> groups of equal packs

    def put(count: int, pattern: tuple, left: int) -> None:
        room.setdefault(left, []).append((count, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        free = max((r for r, groups in room.items() if groups), default=0)
        while n and free >= length:
            groups = room.get(free)
            if not groups:
                free -= 1
                continue
            count, pattern = groups.pop()
            # one at a time, a pack that stays the shortest keeps taking: as often as it stays ahead of the next
            following = max((r for r in room if r < free and room[r]), default=0) if not groups else free
            times = 1 if groups else max(1, min((free - max(following, length)) // length + 1, free // length))
            packs, rest = divmod(n, times)
            if packs >= count:
                put(count, (*pattern, (length, times)), free - times * length)
                n -= count * times
                continue
            put(packs, (*pattern, (length, times)), free - times * length) if packs else None
            left = count - packs
            if rest:
                put(1, (*pattern, (length, rest)), free - rest * length)
                left -= 1
            if left:
                put(left, pattern, free)
            n = 0
        if n:
            times = size // length
            packs, rest = divmod(n, times)
            if packs:
                put(packs, ((length, times),), size - times * length)
            if rest:
                put(1, ((length, rest),), size - rest * length)
    return [(count, _merged(pattern)) for groups in room.values() for count, pattern in groups]


def _merged(pattern: tuple) -> list[tuple[int, int]]:
    out: dict[int, int] = {}
    for length, times in pattern:
        out[length] = out.get(length, 0) + times
    return sorted(out.items(), reverse=True)


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per place of a pattern: length, first rank, times per pack, offset in the pack, first sequence."""
    rows, next_rank, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, times, offset, sequence))
            next_rank[length] = rank + count * times
            offset += length * times
        sequence += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "offset", "sequence"), table.T.copy(), strict=True))


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 within a length: counts per chunk and length first, then places within the chunk.

    Chunks hold about PIECES_PER_CHUNK pieces whatever their lengths, so that no length, however common, is a group.
    """
    chunks = max(1, math.ceil(total / PIECES_PER_CHUNK))
    rows = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "chunk").agg(F.count("*").alias("n")).select(
        "length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    return rows.withColumn("at", F.row_number().over(within) - 1).join(firsts, ["length", "chunk"]) \
        .withColumn("rank", F.col("first") + F.col("at")).drop("chunk", "first", "at")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").store(pieces(docs, tokenizer_path, id_col, text_col, size, end_id), "pieces", result=True)
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    table = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        step = np.int64(2 ** 50)  # ranks within a length stay below
        starts = at["length"] * step + at["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(starts, length * step + rank, side="right") - 1
            k, times = rank - at["rank"][slot], at["times"][slot]
            sequence, offset = at["sequence"][slot] + k // times, at["offset"][slot] + k % times * length
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked(cut, sum(histogram.values())).mapInArrow(place, schema)
