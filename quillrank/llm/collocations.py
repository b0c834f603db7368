"""Phrases that stick together: an FM-index over the words of each shard, intervals extended word by word, counts added up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.session import pin, tasks_for

#: Bytes of text of a shard, about. A shard ends at the end of a document.
SHARD_BYTES = 1 << 24
#: Bytes of text that are cut into words at a time, about.
SLICE_BYTES = 1 << 21
#: Longest phrase, least count, share of a phrase's count from which a longer phrase stands for it, in hundredths.
WORDS, LEAST, COVERED = 4, 30, 80
#: Scores are shares of this.
SCALE = 2_000_000
#: Name of documents without a language.
NO_LANG = "und"
#: A row of a shard's index is at most this; shard and row make up one number.
ROW_BITS = 31
#: Shards of one task at most.
PER_TASK_BITS = 12
#: Shards of one part of the rounds, about.
SHARDS = 4
#: Words of text for each part in which longer phrases are added up; a place in the text is at most one row there.
PART_WORDS = 1 << 21
#: Parts that a language's phrases are ranked in first.
PARTS = 64

#: A-Z to lower case, ends of pieces to line feeds, tab to space; all other bytes stay.
MAPPED = np.arange(256, dtype=np.uint8)
MAPPED[65:91] += 32
MAPPED[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = 10
MAPPED[9] = 32


def symbols(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of all texts as numbers from 1 with a 0 after each piece, and the words by number.

    Texts are cut into words by slices of about ``SLICE_BYTES``; what stays of a slice are numbers and its distinct words.
    """
    texts = texts.cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    coded, sizes, start = [], [], 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = int(np.searchsorted(ends, done + SLICE_BYTES)) + 1
        words, per_piece = _words(texts.slice(start, stop - start))
        coded.append(words.dictionary_encode())
        sizes.append(per_piece)
        start = stop
    if not coded:
        return np.zeros(0, np.int32), pa.array([], pa.large_string())
    coded = pa.chunked_array(coded).unify_dictionaries()
    parts = []
    for chunk, per_piece in zip(coded.chunks, sizes):
        ids = np.zeros(len(chunk) + len(per_piece), np.int32)
        is_word = np.ones(len(ids), bool)
        is_word[np.cumsum(per_piece + 1) - 1] = False
        ids[is_word] = np.asarray(chunk.indices, dtype=np.int32) + 1
        parts.append(ids)
    return np.concatenate(parts), coded.chunk(0).dictionary


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of some texts in order, and how many of them each piece has that has any."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    first, last = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)[[0, -1]]
    mapped = MAPPED[np.frombuffer(data, np.uint8, last - first, first)] if last > first else np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) - first
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(mapped))
    split = pc.split_pattern(pc.split_pattern(texts, "\n").flatten(), " ")
    words = split.flatten()
    real = pc.not_equal(words, "")
    per_piece = np.add.reduceat(np.r_[np.asarray(real), False].astype(np.int64), np.asarray(split.offsets)[:-1]) if len(split) else np.zeros(0, np.int64)
    return words.filter(real), per_piece[per_piece > 0]


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. Every 0 is a symbol of its own, before all words, earlier ones first.

    Places and ranks have 32 bits, as a row of the index has at most ``ROW_BITS``.
    """
    n = len(ids)
    if n >> ROW_BITS:
        raise ValueError("too many words in one shard")
    ends = int((ids == 0).sum())
    rank = ids.astype(np.int32) + np.int32(ends)
    rank[ids == 0] = np.arange(ends, dtype=np.int32)
    # Ranks of one symbol are made ranks of two, four, ...; only suffixes that still tie are sorted again.
    order = np.argsort(rank, kind="stable").astype(np.int32)
    tied = np.arange(n, dtype=np.int32)
    _rank(rank[order], order, rank, tied)
    length, tied = 1, _tied(rank, order, tied)
    while len(tied):
        places = order[tied]
        key = rank[places].astype(np.int64)
        key *= n + 1
        inside = places < n - length
        key[inside] += rank[places[inside] + np.int32(length)]
        key[inside] += 1
        del inside
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[tied] = places[by]
        del by, places
        _rank(key, order[tied], rank, tied)
        del key
        tied = _tied(rank, order, tied)
        length *= 2
    return order


def _rank(keys: np.ndarray, places: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
    """Put in the rank of each suffix: the row of the first one with its key."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    rank[places] = np.repeat(at[first], np.diff(np.r_[first, len(keys)]))


def _tied(rank: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows among ``at`` whose suffix shares its rank."""
    own = rank[order[at]]
    same = own[1:] == own[:-1]
    return at[np.r_[same, False] | np.r_[False, same]] if len(at) > 1 else at[:0]


class Index:
    """FM-index of one shard: the preceding symbol of each suffix in order; symbol starts and rank steps follow from it."""

    def __init__(self, before: np.ndarray):
        self.before = before
        counts = np.bincount(before, minlength=1)
        self.first = np.cumsum(counts) - counts
        self.counts = counts
        self._step: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Index:
        order = suffix_array(ids)
        return cls(ids[order - 1])  # the first symbol's predecessor is the last end

    @property
    def step(self) -> np.ndarray:
        """Row of the suffix that is one word longer on the left: start of its symbol and that symbol's rank so far."""
        if self._step is None:
            self._step = np.empty(len(self.before), np.int64)
            self._step[np.argsort(self.before, kind="stable")] = np.arange(len(self.before))
        return self._step

    def extend(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals (start, size) of all phrases one word longer whose parts are both among the given intervals.

        Returns start and size of each, and the numbers of the interval that holds
        it (its words but the last, extended to the right) and of the interval it
        was reached from (its words but the first, extended to the left).
        """
        owner = np.full(len(self.before), -1, np.int32)
        by = np.argsort(start)
        rows = np.repeat(start[by] - np.r_[0, np.cumsum(size[by])[:-1]], size[by]) + np.arange(int(size.sum()))
        owner[rows] = np.repeat(by, size[by])
        rows = rows[self.before[rows] > 0]
        reached = self.step[rows]
        inside = owner[reached] >= 0
        came = np.full(len(self.before), -1, np.int32)
        came[reached[inside]] = owner[rows[inside]]
        at = np.flatnonzero(came >= 0)
        left, right = owner[at], came[at]
        fresh = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(at) else at
        return at[fresh], np.diff(np.r_[fresh, len(at)]), left[fresh], right[fresh]


def indexed(docs: DataFrame) -> DataFrame:
    """(shard, lang, n, words, before): the index of each shard, ``before`` compressed and ``n`` the number of words. A shard has one language."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}
        made = 0
        task = TaskContext.get().partitionId() << PER_TASK_BITS

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            sizes.pop(lang)
            ids, words = symbols(pa.concat_arrays(held.pop(lang)))
            if len(ids):
                if made >> PER_TASK_BITS:
                    raise ValueError("too many shards in one task; read the table in smaller splits")
                packed = zstandard.ZstdCompressor(level=3).compress(Index.of(ids).before.tobytes())
                row = [pa.array([task + made]), pa.array([lang]), pa.array([int((ids > 0).sum())]), pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), pa.array([packed])]
                made += 1
                yield pa.RecordBatch.from_arrays(row, names=["shard", "lang", "n", "words", "before"])

        for batch in batches:
            for number, lang in enumerate(batch["lang"].unique().to_pylist()):
                own = batch["text"].filter(pc.equal(batch["lang"], lang)).cast(pa.large_string())
                start = 0
                ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(own), 0)))
                while start < len(own):
                    done = int(ends[start - 1]) if start else 0
                    stop = int(np.searchsorted(ends, done + SHARD_BYTES - sizes.get(lang, 0))) + 1
                    part = own.slice(start, stop - start)
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + int(ends[min(stop, len(own)) - 1]) - done
                    start = stop
                    if sizes[lang] >= SHARD_BYTES:
                        yield from close(lang)
                while sum(sizes.values()) > 2 * SHARD_BYTES:
                    yield from close(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from close(lang)

    docs = docs.select("text", F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    return docs.mapInArrow(build, "shard long, lang string, n long, words array<string>, before binary")


def _unpacked(column: pa.Array) -> Iterator[Index]:
    for packed in column:
        raw = zstandard.ZstdDecompressor().decompress(packed.as_buffer())
        yield Index(np.frombuffer(raw, np.int32))


def _place(batch: pa.RecordBatch, row: int) -> int:
    """What is added to a row of a shard's index to tell it from those of other shards."""
    return batch["shard"][row].as_py() << ROW_BITS


def _single_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, index in enumerate(_unpacked(batch["before"])):
            words = batch["words"][row].values
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch["lang"][row].as_py()] * len(words)), words, pa.array(_place(batch, row) + index.first[1:].astype(np.int64)),
                 pa.array(index.counts[1:].astype(np.int32))], names=["lang", "word", "place", "size"])


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers in few bytes, byte by byte; of every other column, beginning with the first, the differences, as they rise or repeat."""
    numbers = np.concatenate([c if k % 2 else np.diff(c, prepend=0) for k, c in enumerate(columns)]).astype(np.int64)
    return zstandard.ZstdCompressor(level=3).compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes, columns: int = 4) -> list[np.ndarray]:
    """The columns as ``packed`` got them."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    numbers = np.ascontiguousarray(planes.T).view(np.int64).reshape(columns, -1)
    return [c if k % 2 else np.cumsum(c) for k, c in enumerate(numbers)]


def _known(values: pa.Array) -> list[np.ndarray]:
    """Start, size and phrase of a shard's intervals, from rows of them or packed."""
    if pa.types.is_struct(values.type):
        return [np.asarray(values.field(k)) for k in range(3)]
    return [np.concatenate(c) for c in zip(*(unpacked(data, 3) for data in values.to_pylist()))]


def _parts_of(head: np.ndarray, tail: np.ndarray, parts: int) -> np.ndarray:
    """Part of each phrase: a head is dealt to a 16th of the parts, at least four, by its tails, so that heads repeat and no head fills a part."""
    mixed = lambda x: (y := (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)) ^ (y >> np.uint64(31))
    several = max(4, parts // 16)
    own = mixed(tail) % np.uint64(several) * np.uint64(max(1, parts // several))
    return ((mixed(head) % np.uint64(parts) + own) % np.uint64(parts)).astype(np.int32)


def _extended(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Intervals of phrases one word longer: a row for each shard and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, index in enumerate(_unpacked(batch["before"])):
                start, size, phrase = _known(batch["known"][row].values)
                at, sizes, left, right = index.extend(start, size)
                found = at, sizes, phrase[left], phrase[right]
                part = _parts_of(*found[2:], parts)
                by = np.argsort(part, kind="stable")
                some = np.unique(part)
                cuts = np.split(by, np.searchsorted(part[by], some[1:])) if len(some) else []
                columns = [pa.array(some), pa.array([batch["shard"][row].as_py()] * len(some), pa.int64()),
                           pa.array([packed(*(x[own] for x in found)) for own in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "found"])

    return run


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of one part with ``LEAST`` occurrences in all shards: each shard's intervals packed, and without a shard all phrases."""
    held = [(shard, *unpacked(data)) for b in batches for shard, data in zip(b["shard"].to_pylist(), b["found"].to_pylist())]
    if not held:
        return
    place = np.concatenate([(shard << ROW_BITS) + start for shard, start, *_ in held])
    size, head, tail = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
    del held
    by = np.lexsort((place, tail, head))
    place, size, head, tail = (x[by] for x in (place, size, head, tail))
    del by
    first = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]) if len(place) else np.zeros(0, np.int64)
    each = np.diff(np.r_[first, len(place)])
    count = np.add.reduceat(size, first) if len(place) else size
    frequent = count >= LEAST
    first = first[frequent]
    rows = [(None, packed(place[first], count[frequent], head[first], tail[first]))]
    kept = np.repeat(frequent, each)
    phrase = np.repeat(place[first], each[frequent])
    place, size = place[kept], size[kept]
    by = np.argsort(place)
    shard = place[by] >> ROW_BITS
    for own in np.split(by, np.flatnonzero(shard[1:] != shard[:-1]) + 1) if len(by) else ():
        rows.append((int(place[own[0]] >> ROW_BITS), packed(place[own] & ((1 << ROW_BITS) - 1), size[own], phrase[own])))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "known"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch["known"].to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpacked(data)], names=["phrase", "count", "head", "tail"])


def _frequent(rows: DataFrame, *keys: str) -> DataFrame:
    """Intervals of phrases with ``LEAST`` occurrences in all shards, with their count and number.

    A phrase has one row a shard. Its number is the smallest place of any of its
    intervals; only the row of that place keeps the keys.
    """
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("count", F.sum("size").over(own)).withColumn("phrase", F.min("place").over(own)).where(F.col("count") >= LEAST)
    first = F.col("phrase") == F.col("place")
    return rows.select("place", "size", "phrase", *(F.when(first, F.col(c)).alias(c) for c in ("count", *keys)))


def score(count: Column | str, left: Column | str, right: Column | str) -> Column:
    """floor(SCALE * count / (left + right)), also where the product passes 64 bits."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * whole(count), whole(left) + whole(right))


def phrases(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Phrases of 1, 2, ... words with their counts, by number of words; and the words of each language.

    Frames have (phrase, lang, text, last, count, heads, tails, head, tail): ``heads`` and ``tails``
    are the counts of the first and the last 1, 2, ... words; ``head`` and ``tail`` the numbers of
    the phrases without the last and without the first word.
    """
    spark = docs.sparkSession
    shards = pin(indexed(docs), "phrase-index")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    words = shards.mapInArrow(_single_words, "lang string, word string, place long, size int")
    found = pin(_frequent(words, "lang", "word"), "phrase-rows")
    own = F.array("count")
    single = found.where("phrase = place")
    levels = [single.select("phrase", "lang", F.col("word").alias("text"), F.col("word").alias("last"), own.alias("heads"), own.alias("tails"), "count")]
    # All rounds meet the indexes where one shuffle has put them.
    held = shards.agg(F.count(F.lit(1)), F.sum("n")).first()
    parts = max(1, -(-held[0] // SHARDS))
    adding = tasks_for(spark, held[1] or 0, PART_WORDS)
    indexes = shards.select("shard", "before").repartition(parts, "shard").persist(StorageLevel.DISK_ONLY)
    shard, start = F.shiftright("place", ROW_BITS).alias("shard"), F.col("place").bitwiseAND((1 << ROW_BITS) - 1).alias("start")
    known = found.select(shard, F.struct(start, "size", "phrase").alias("known"))
    for _ in range(1, WORDS):
        known = known.repartition(parts, "shard").groupBy("shard").agg(F.collect_list("known").alias("known"))
        longer = indexes.join(known.hint("shuffle_hash"), "shard").select("shard", "before", "known")
        # Most of what is shuffled at all: packed by shard and part, a row of Spark's takes three times as many bytes.
        longer = longer.mapInArrow(_extended(adding), "part int, shard long, found binary").repartitionById(adding, F.col("part"))
        found = pin(longer.mapInArrow(_added_up, "shard long, known binary"), "phrase-rows")
        known = found.where("shard IS NOT NULL")
        before = levels[-1]
        front = before.select(F.col("phrase").alias("head"), "lang", F.col("text").alias("front"), "heads")
        back = before.select(F.col("phrase").alias("tail"), "last", "tails")
        listed = found.where("shard IS NULL").select("known").mapInArrow(_listed, "phrase long, count long, head long, tail long")
        longer = listed.join(front, "head").join(back, "tail").select(
            "phrase", "lang", F.concat_ws(" ", "front", "last").alias("text"), "last", "count",
            F.concat("heads", F.array("count")).alias("heads"), F.concat("tails", F.array("count")).alias("tails"), "head", "tail")
        levels.append(pin(longer, "phrases"))
    indexes.unpersist()
    return levels, totals


def collocations(docs: DataFrame, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of 2 to ``WORDS`` words.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line ends into pieces
    and these at spaces and tabs into words. Counts are per language: ``n`` of all
    words, ``a`` of the phrase within pieces, overlaps included. Phrases with
    ``a >= LEAST`` are candidates; the score is floor(SCALE * a / (l + r)) of the cut
    where it is lowest, the earliest of those, with ``l`` and ``r`` the counts of the two
    parts. A phrase inside a longer candidate with ``COVERED`` hundredths of its count
    is left out. Ties by ``a``, then by phrase in UTF-8 order. Exact over all rows.

    Null and empty texts have no words, a null language is ``und``, repeated rows
    count each time, an empty table gives no rows, other columns are not read.

    Each shard of about ``SHARD_BYTES`` holds a suffix array's FM-index in memory; a
    phrase sends one row a shard, however often it stands there, and only phrases
    whose two parts are frequent in all shards together are formed at all.
    """
    levels, totals = phrases(docs.select("text", "lang"))
    every = None
    for size in range(2, WORDS + 1):
        own = levels[size - 1]
        if size < WORDS:
            longer = levels[size]
            around = longer.select(F.col("head").alias("phrase"), F.col("count").alias("around"))
            around = around.union(longer.select(F.col("tail").alias("phrase"), F.col("count").alias("around")))
            around = around.groupBy("phrase").agg(F.max("around").alias("around"))
            covered = F.lit(100).cast("decimal(19,0)") * F.col("around") >= F.lit(COVERED).cast("decimal(19,0)") * F.col("count")
            own = own.join(around, "phrase", "left").where(~F.coalesce(covered, F.lit(False)))
        cuts = []
        for k in range(1, size):
            left, right = F.col("heads")[k - 1], F.col("tails")[size - k - 1]
            cuts.append(F.struct(score("count", left, right).alias("score"), F.lit(k).alias("cut"), left.alias("l"), right.alias("r")))
        lowest = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
        own = own.withColumn("low", lowest).select("lang", F.col("text").alias("phrase"), F.col("count").alias("a"), "low.l", "low.r", "low.score")
        every = own if every is None else every.unionByName(own)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = every.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.where(F.col("rank") <= most).drop("rank", "part")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

