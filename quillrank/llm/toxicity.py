"""Toxicity from the nearest labelled examples: exact cosine of weighted TF-IDF over all terms, by a block-max index.

Terms that no example has add to no product and change all cosines of a document by one
factor, which neither order nor votes depend on, so the vocabulary is that of the examples.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import by_piece, pieces
from quillrank.session import pin

#: Labelled rows of each class that vocabulary and examples come from, at most, chosen by a hash of the document id.
PER_CLASS = 8_000
#: Beginnings of words that are terms beside the words; sizes of the character n-grams where words have no spaces.
BEGINNINGS, GRAMS = (4, 5), (2, 3)
#: Nearest examples that vote, examples of a block, votes that the share of a class counts for.
NEIGHBOURS, BLOCK, PRIOR = 15, 64, 0.5
#: Terms in at least one of so many examples have a dense row, the commonest ones, at most so many.
ONE_IN, DENSE = 16, 1024
#: Counts from 1 on that a posting itself tells.
FEW = 4
#: Documents searched at a time, words whose terms a worker keeps.
TOGETHER, REMEMBERED = 128, 200_000
#: Examples whose terms are worked on at a time when an index is made.
AT_ONCE = 500
SCORED = "doc_id long, score double, predicted int, evidence array<long>"
WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, which have a star; character n-grams of what is written without spaces."""
    if not word.isascii() and max(word) >= "\u0e00" and UNSPACED.search(word):
        runs = UNSPACED.findall(word)
        pairs = [run[i : i + n] for run in runs for n in GRAMS for i in range(len(run) - n + 1)]
        rest = [t for part in UNSPACED.split(word) if part for t in terms_of(part)]
        return [*pairs, *(run for run in runs if len(run) < min(GRAMS)), *rest]
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def held_out(key: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


Vector = tuple[np.ndarray, np.ndarray]


class Index:
    """Examples with a dense row for each common term in single precision and postings of the others.

    A term's weight in an example is idf * (1 + excess) * scale, with one idf a term and one
    scale an example. Terms that stand once in an example have no excess, those that stand
    twice or three times one of a few. So a posting is one number, its example's place and
    which of the ``few`` excesses it has; another list has those with other excesses.
    Rows are (id, label, weight by term); ``Index.of`` takes counts as arrays.
    """

    def __init__(self, rows: list[tuple[int, int, dict[int, float]]], terms: int):
        sizes = [len(r[2]) for r in rows]
        term = np.fromiter((t for r in rows for t in r[2]), np.int64, sum(sizes))
        weight = np.fromiter((w for r in rows for w in r[2].values()), np.float64, sum(sizes))
        ids, labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self._build(ids, labels, sizes, term, weight, np.ones(terms), np.ones(len(rows)), lambda w: w - 1)

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> Index:
        """The index of unit vectors with the weights idf * (1 + log(count))."""
        excess = lambda n: np.log(n.astype(np.float64))
        scale = np.ones(len(ids))
        for a, b, own in _some(np.cumsum(np.asarray(sizes, np.int64))):
            weight = (1 + excess(count[own])) * idf[term[own]]
            scale[a:b] = 1 / np.sqrt(np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), weight * weight, b - a))
        index = cls.__new__(cls)
        index._build(ids, labels, sizes, term, count, idf, scale, excess)
        return index

    def _build(self, ids, labels, sizes, term, value, idf, scale, excess) -> None:
        # Worked out for some examples after the other: each worker has an index, and copies of all weights would be larger than it.
        some, terms = _some(np.cumsum(np.asarray(sizes, np.int64))), len(idf)
        rows = lambda a, b: np.repeat(np.arange(a, b, dtype=np.int32), np.asarray(sizes[a:b]))
        self.few = excess(np.arange(1, 1 + FEW))
        number, other = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        for _, _, own in some:
            number += np.bincount(term[own], minlength=terms)
            other += np.bincount(term[own][~np.isin(excess(value[own]), self.few)], minlength=terms)
        common = np.argsort(-number, kind="stable")[:DENSE]
        common = common[(number[common] > 0) & (number[common] * ONE_IN >= len(ids))]
        self.place = np.full(terms, -1, np.int16)
        self.place[common] = np.arange(len(common))
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.idf = ids[order], labels[order], idf
        self.blocks = max(1, -(-len(ids) // BLOCK))
        self.room = self.blocks * BLOCK
        self.scale = np.ones(self.room)
        self.scale[: len(ids)] = scale[order]
        to = np.empty(len(ids), np.int32)
        to[order] = np.arange(len(ids))
        # Postings by term, of one term in the order of the examples; and the common terms of each example.
        each = np.bincount(np.repeat(to, sizes), self.place[term] >= 0, len(ids)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        number[common] = 0
        number -= np.where(number > 0, other, 0)
        other[common] = 0
        ends = lambda n: np.concatenate(([0], np.cumsum(n))).astype(np.int32 if n.sum() < 1 << 31 else np.int64)
        self.starts, self.starts_other, self.starts_common = ends(number), ends(other), ends(each)
        self.row = np.empty(self.starts[-1], np.uint16 if self.room * FEW <= 1 << 16 else np.int32)
        self.row_other, self.weight = np.empty(self.starts_other[-1], np.int32), np.empty(self.starts_other[-1])
        self.common, self.common_weight = np.empty(self.starts_common[-1], np.int16), np.empty(self.starts_common[-1])
        free, free_other = self.starts[:-1].copy(), self.starts_other[:-1].copy()
        self.tables = np.zeros((len(common), self.room), np.float32)
        for a, b, own in some:
            column, row, more = self.place[term[own]], to[rows(a, b)], excess(value[own])
            dense = column >= 0
            at, weight = row[dense], idf[term[own][dense]] * (1 + more[dense]) * self.scale[row[dense]]
            self.tables[column[dense], at] = weight
            by_row = np.argsort(at, kind="stable")
            put = _next(self.starts_common[:-1].copy(), at[by_row])
            self.common[put], self.common_weight[put] = column[dense][by_row], weight[by_row]
            by_term = np.lexsort((row[~dense], term[own][~dense]))
            rare, row, more = (x[~dense][by_term] for x in (term[own], row, more))
            kind = np.full(len(rare), -1, np.int32)
            for k, one in enumerate(self.few):
                kind[more == one] = k
            known = kind >= 0
            self.row[_next(free, rare[known])] = row[known] + self.room * kind[known]
            at = _next(free_other, rare[~known])
            self.row_other[at], self.weight[at] = row[~known], more[~known] + 1

    def nearest(self, query: dict[int, float], k: int) -> Vector:
        """Places and cosines of the k nearest examples with a term in common; ties to the smaller id."""
        terms, weights = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        return self.search([(terms, weights)], k)[0]

    def search(self, queries: list[Vector], k: int) -> list[Vector]:
        """``nearest`` of several documents.

        Postings give the part of all uncommon terms, one product in single precision that
        of all common ones. Examples whose sum comes within its rounding of the k-th best
        get the exact part of their common terms.
        """
        total = np.zeros((len(queries), self.room))
        own = np.zeros((len(queries), len(self.tables)))
        factors = 1 + self.few
        for n, (terms, weights) in enumerate(queries):
            place = self.place[terms]
            common = place >= 0
            own[n, place[common]] = weights[common]
            terms = terms[~common]
            weights = weights[~common] * self.idf[terms]
            a, b = self.starts[terms], self.starts[terms + 1]
            if len(found := _joined(self.row, a, b)):
                total[n] = factors @ np.bincount(found, np.repeat(weights, b - a), FEW * self.room).reshape(FEW, self.room)
            a, b = self.starts_other[terms], self.starts_other[terms + 1]
            sizes = b - a
            if sizes.any():
                at = np.arange(sizes.sum()) + np.repeat(a - (np.cumsum(sizes) - sizes), sizes)
                total[n] += np.bincount(self.row_other[at], np.repeat(weights, sizes) * self.weight[at], self.room)
        total *= self.scale
        about = total + own.astype(np.float32) @ self.tables
        # The k-th largest of the blocks' largest sums is at most the k-th largest sum.
        best = about.reshape(len(queries), self.blocks, BLOCK).max(2)
        low = np.partition(best, self.blocks - k, axis=1)[:, self.blocks - k] if self.blocks >= k else np.zeros(len(queries))
        margin = 2 * (len(self.tables) + 8) * 2.0**-24
        return [self._first(total[n], about[n], own[n], low[n] - margin, k) for n in range(len(queries))]

    def _first(self, rare: np.ndarray, about: np.ndarray, own: np.ndarray, low: float, k: int) -> Vector:
        found = np.flatnonzero((about >= low) & (about > 0))
        a, b = self.starts_common[found], self.starts_common[found + 1]
        products = own[_joined(self.common, a, b)] * _joined(self.common_weight, a, b)
        score = np.minimum(rare[found] + np.bincount(np.repeat(np.arange(len(found)), b - a), products, len(found)), 1.0)
        best = np.lexsort((self.ids[found], -np.round(score, 12)))[:k]
        return found[best], score[best]


def _some(ends: np.ndarray) -> list[tuple[int, int, slice]]:
    """First and last of ``AT_ONCE`` examples after the other, and where their terms are."""
    some = [(a, min(a + AT_ONCE, len(ends))) for a in range(0, len(ends), AT_ONCE)]
    return [(a, b, slice(int(ends[a - 1]) if a else 0, int(ends[b - 1]))) for a, b in some]


def _next(free: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places for sorted ``terms``: the next free ones of each, which are taken."""
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    each = np.diff(np.r_[first, len(terms)])
    at = np.arange(len(terms)) + np.repeat(free[terms[first]] - first, each)
    free[terms[first]] += each.astype(free.dtype)
    return at


def _joined(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs of ``values`` one after the other."""
    return np.concatenate([values[:0], *[values[a:b] for a, b in zip(starts.tolist(), ends.tolist())]])


class Known(dict):
    """Numbers of words; the terms of a word are worked out when it is met."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.terms, self.sizes = vocabulary, array("i"), array("i")

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        vocabulary = self.vocabulary
        found = [vocabulary[t] for t in terms_of(word) if t in vocabulary]
        self.terms.extend(found)
        self.sizes.append(len(found))
        return number


class Finder:
    """Finds the terms of a vocabulary in texts; about ``REMEMBERED`` words are kept, also from task to task where it is sent to them."""

    def __init__(self, vocabulary: dict[str, int]):
        self.known = Known(vocabulary)

    def __reduce__(self):
        return Finder, (self.known.vocabulary,)

    def __call__(self, text: str) -> dict[int, int]:
        """How often each term stands in ``text``."""
        _, terms, counts = self.table([text])
        return dict(zip(terms.tolist(), counts.tolist()))

    def table(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many terms each text has, and the terms with their counts, one text's after the other's."""
        if len(self.known) >= REMEMBERED:
            self.known = Known(self.known.vocabulary)
        known = self.known
        words = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in (WORD.findall(t.lower()) for t in texts)]
        text = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        one = max(1, len(known))
        key, number = np.unique(text * one + np.concatenate([np.zeros(0, np.int64), *words]), return_counts=True)
        text, word = np.divmod(key, one)
        sizes = np.array(known.sizes, np.int64)
        starts, each = (np.cumsum(sizes) - sizes)[word], sizes[word]
        term = np.array(known.terms, np.int64)[np.arange(each.sum()) + np.repeat(starts - (np.cumsum(each) - each), each)]
        one = max(1, len(known.vocabulary))
        key = np.repeat(text, each) * one + term
        order = np.argsort(key)
        key, number = key[order], np.repeat(number, each)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        text, term = np.divmod(key[first], one)
        return np.bincount(text, minlength=len(texts)), term, np.add.reduceat(number, first) if len(key) else number


@dataclass
class Examples:
    """Ids, labels and numbers of terms of the examples, and their terms with counts one after the other."""

    ids: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


@dataclass
class Model:
    """Vocabulary with the terms' weights, examples and how much a vote of each class counts.

    The index is made where it is used, since it is larger than the counts.
    """

    vocabulary: dict[str, int]
    idf: np.ndarray
    examples: Examples
    votes: tuple[float, float]
    share: float
    share_without: float

    @cached_property
    def index(self) -> Index:
        # A worker has no more use for the examples.
        own, self.examples = self.examples, None
        return Index.of(own.ids, own.labels, own.sizes, own.terms, own.counts, self.idf if len(self.idf) else np.ones(1))

    @cached_property
    def finder(self) -> Finder:
        return Finder(self.vocabulary)

    def vectors(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[Vector]:
        """Terms and weights of unit vectors over the vocabulary, from terms as ``Finder.table`` gives them."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights * weights, len(sizes)))
        weights /= np.repeat(norms, sizes)
        ends = np.cumsum(sizes)
        return [(terms[b - n : b], weights[b - n : b]) for n, b in zip(sizes.tolist(), ends.tolist())]

    def score(self, texts: list[str]) -> Iterator[tuple[float, list[int]]]:
        """``rate`` of each text."""
        for start in range(0, len(texts), TOGETHER):
            yield from self.rate(*self.finder.table(texts[start : start + TOGETHER]))

    def rate(self, *table: np.ndarray) -> Iterator[tuple[float, list[int]]]:
        """Score of each document and the ids of the examples that it rests on, nearest first.

        A vote counts by its cosine and by how many labelled rows of its class the
        example stands for; the share of label 1 counts as ``PRIOR`` votes. Without
        any term of an example the score is the share of label 1 among examples without terms.
        """
        vectors = self.vectors(*table)
        for (terms, _), (at, cosine) in zip(vectors, self.index.search(vectors, NEIGHBOURS)):
            if not len(terms):
                yield self.share_without, []
                continue
            weight = cosine * np.take(self.votes, self.index.labels[at])
            scale = PRIOR * (weight.mean() if len(weight) else 1.0)
            toxic = float((weight * self.index.labels[at]).sum())
            total = float(weight.sum()) + scale
            yield (toxic + scale * self.share) / total, self.index.ids[at].tolist()


def packed(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Terms and counts of some documents in few bytes; a document's terms rise and are kept as differences, byte by byte."""
    first = np.cumsum(sizes) - sizes
    step = np.diff(terms, prepend=0)
    step[first[sizes > 0]] = terms[first[sizes > 0]]
    numbers = np.concatenate([np.array([len(sizes)], np.uint32), sizes.astype(np.uint32), step.astype(np.uint32), counts.astype(np.uint32)])
    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, terms and counts as ``packed`` got them."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
    sizes = numbers[1 : 1 + numbers[0]]
    step, counts = np.split(numbers[1 + numbers[0] :], 2)
    # Sums run over all documents; what a document's first term adds to those before it is taken off.
    total, first = np.cumsum(step), np.cumsum(sizes) - sizes
    some = sizes > 0
    before = np.concatenate(([0], total))[first[some]]
    return sizes, total - np.repeat(before, sizes[some]), counts


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    weights = {t: (1 + np.log(n)) * idf[t] for t, n in counts.items()}
    size = float(np.sqrt(sum(w * w for w in weights.values())))
    return {t: float(w) / size for t, w in weights.items()} if size else {}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents that aren't held out; document frequencies are those of all of ``docs``.

    Labels are taken from a bounded sample, ``PER_CLASS`` rows of each class; of
    rows with one doc_id the largest label counts, null labels don't.
    """
    return _learned(docs, labels, False)[0]


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of ``docs`` by the model that ``fit`` learns from them; terms are found once and kept in the shared folder."""
    model, found = _learned(docs, labels, True)
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, vocabulary={}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch["doc_ids"].to_pylist(), batch["found"].to_pylist()):
                votes = list(sent.value.rate(*unpacked(data)))
                yield _scored(ids, votes)

    return _with_held_out(found.mapInArrow(work, SCORED))


def _learned(docs: DataFrame, labels: DataFrame, keep: bool) -> tuple[Model, DataFrame]:
    """The model of ``fit``, and ``docs`` or, to ``keep`` them, a table of its rows' ids and terms."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = dict(known.groupBy("label").count().collect())
    picked = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    # At most twice PER_CLASS rows of two numbers.
    sample = spark.createDataFrame([tuple(r) for p in picked for r in p.collect()], "doc_id long, label int")
    # Copies would make the words of one text look like a mark of its label.
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label").dropDuplicates(["text", "label"])
    rows = pin(rows, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        size = [0, 0]
        for _, texts, classes in pieces(batches):
            for text, label in zip(texts, classes):
                size[label] += 1
                counts[label].update({t for w in set(WORD.findall(text.lower())) for t in terms_of(w)})
        terms = list(counts[0].keys() | counts[1].keys())
        columns = [[*terms, ""], *([*(counts[c][t] for t in terms), size[c]] for c in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "n0", "n1"])

    counted = rows.mapInArrow(count, "term string, n0 long, n1 long").groupBy("term")
    # A row for each term of the sample, the empty term's with the numbers of examples.
    counted = counted.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("term").toArrow()
    terms = counted["term"].to_pylist()
    n0, n1 = (counted[c].to_numpy() for c in ("n0", "n1"))
    size0, size1 = (int(n[0]) if len(n) else 0 for n in (n0, n1))
    vocabulary = {t: n for n, t in enumerate(islice(terms, 1, None))}
    del counted, terms
    # How far a term leans to label 1: 1 and more, so that no term is without weight.
    lean = np.log2(2 + n1[1:] / np.maximum(1.0, n0[1:] * (size1 / max(1, size0))))
    sent = spark.sparkContext.broadcast(Finder(vocabulary))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, tuple]]:
        for ids, texts in pieces(batches):
            for start in range(0, len(texts), TOGETHER):
                yield ids[start : start + TOGETHER], sent.value.table(texts[start : start + TOGETHER])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in tables(batches):
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([packed(*found)])], names=["doc_ids", "found"])

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        seen = 0
        for sizes, terms, _ in (unpacked(data) for b in batches for data in b["found"].to_pylist()) if keep else (t for _, t in tables(batches)):
            total += np.bincount(terms, minlength=size)
            seen += len(sizes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], seen))], names=["term", "n"])

    size = len(vocabulary)
    every = pin(docs.mapInArrow(kept, "doc_ids array<long>, found binary"), "terms") if keep else docs
    # A row for each term of the vocabulary.
    found = every.mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    number = np.zeros(size + 1, np.int64)
    number[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = (np.log((1 + number[-1]) / (1 + number[:-1])) + 1) * lean

    def example(ids: list, texts: list[str], classes: list) -> dict[str, list]:
        sizes, *found = sent.value.table(texts)
        ends = np.cumsum(sizes)
        terms, counts = ([f[b - n : b].astype(np.int32) for n, b in zip(sizes, ends)] for f in found)
        return {"doc_id": ids, "label": classes, "terms": terms, "counts": counts}

    kind = "doc_id long, label int, terms array<int>, counts array<int>"
    # At most twice PER_CLASS rows; the driver makes no Python values of them.
    vectors = by_piece(rows, example, kind).toArrow()
    sent.destroy()
    ids, classes = vectors["doc_id"].to_numpy(), vectors["label"].to_numpy()
    lengths = pc.list_value_length(vectors["terms"]).to_numpy().astype(np.int64)
    some = lengths > 0
    flat = lambda c: np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in vectors[c].chunks)])
    count = flat("counts")
    small = np.uint16 if not len(count) or count.max() < 1 << 16 else np.int32
    count = count.astype(small)
    examples = Examples(ids[some], classes[some], lengths[some], flat("terms"), count)
    del vectors
    sizes = [int((classes == c).sum()) for c in (0, 1)]
    votes = tuple(totals.get(c, 0) / sizes[c] if sizes[c] else 0.0 for c in (0, 1))
    all_rows = totals.get(0, 0) + totals.get(1, 0)
    share = totals.get(1, 0) / all_rows if all_rows else 0.0
    without = [votes[c] * int(((classes == c) & ~some).sum()) for c in (0, 1)]
    share_without = without[1] / sum(without) if sum(without) else share
    return Model(vocabulary, idf, examples, votes, share, share_without), every


def _scored(ids: list, votes: list[tuple[float, list[int]]]) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array([s for s, _ in votes], pa.float64()), pa.array([int(s >= 0.5) for s, _ in votes], pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([e for _, e in votes], pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"])


def _with_held_out(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document.

    ``score`` is 0 to 1, ``predicted`` 1 from 0.5 on, ``evidence`` the ids of the
    examples that voted. A null or empty text has the score of texts without any
    known term. Repeated rows give repeated rows, an empty table none; columns other
    than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            yield _scored(ids, list(sent.value.score(texts)))

    return _with_held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCORED))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, all their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            for start in range(0, batch.num_rows, 256):
                part = [t or "" for t in texts.slice(start, 256).to_pylist()]
                yield batch.slice(start, 256).filter(pa.array([s < 0.5 for s, _ in sent.value.score(part)]))

    return docs.mapInArrow(keep, docs.schema)
