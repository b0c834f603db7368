"""Document rates that bring soft domains to target weights: domain posteriors and projected-gradient least squares."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import by_piece
from quillrank.llm.shingles import chunks, mix, word_hashes
from quillrank.session import pin

#: Domains of labelled documents.
DOMAINS = ("high", "low", "toxic")
#: Labelled rows that the classifier is fitted on, at most, chosen by a hash of the document id.
SAMPLE = 4_000
#: Hashed features; passes of the fit, its step; pull of the weights to zero.
FEATURES, PASSES, RATE, SHRINK = 1 << 14, 80, 0.5, 0.1
#: Steps of the rate fit at most, and the share of all tokens by which a domain may miss its target.
STEPS, MISS = 60, 1e-3
#: Added to ids before they are hashed, so that 0 is drawn like any other.
DRAW = np.uint64(0x9E3779B97F4A7C15)


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Number of a labelled row's domain: toxic, or else high or low by its quality; null without the labels."""
    low_high = F.when(F.col(quality) == 1, 0).when(F.col(quality) == 0, 1)
    return F.when(F.col(toxic) == 1, 2).otherwise(low_high)


@dataclass
class Classifier:
    """Softmax over a document's word weights, added up and divided by the root of their number, its length and its source."""

    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: Sequence[str], sources: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Domain posteriors and words of each text."""
        score, words = [], []
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        for part in chunks(raw):
            index, ends = features(part)
            count = np.diff(np.r_[0, ends])
            sums = np.zeros((len(index) + 1, self.weights.shape[1]))
            np.cumsum(self.weights[index], axis=0, out=sums[1:])
            score.append((sums[ends] - sums[ends - count]) / np.sqrt(np.maximum(count, 1))[:, None])
            words.append(count)
        logits = np.concatenate(score or [np.zeros((0, len(self.bias)))]) + self.bias
        count = np.concatenate(words or [np.zeros(0, np.int64)])
        logits = logits + self.weights[source_features(sources)] / SOURCE
        logits = logits + self.weights[length_features(count)] / SOURCE
        return softmax(logits), count


#: What a source or a length counts for beside a document's words, as a divisor.
SOURCE = 8.0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of texts, one after the other, and where each text's end."""
    hashes, ends = word_hashes(texts)
    return (hashes >> np.uint64(40)).astype(np.int64) & (FEATURES - 1), ends


def source_features(sources: Sequence[str | None]) -> np.ndarray:
    known = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    code, _ = word_hashes([f"source={s}".replace(" ", "_").encode() for s in known]) if known else (np.zeros(0, np.uint64), None)
    code = (mix(code) >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)
    return code[[known[s] for s in sources]]


def length_features(words: np.ndarray) -> np.ndarray:
    """One feature for each doubling of the length."""
    code = mix(np.floor(np.log2(words + 1)).astype(np.uint64) + np.uint64(1))
    return (code >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)


def softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(1, keepdims=True)) if len(logits) else logits
    return out / out.sum(1, keepdims=True) if len(logits) else out


def fit_domains(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on a bounded sample of labelled rows; without any, all domains are equally likely.

    Of rows with one doc_id the last domain counts.
    """
    spark, size = docs.sparkSession, len(DOMAINS)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of().alias("domain")).dropna()
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    # At most SAMPLE rows of two numbers.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    sample = spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, domain int")

    def extract(ids: list, texts: list[str], sources: list, domains: list) -> dict[str, list]:
        index, words = [], []
        for part in chunks([t.encode("utf-8", "surrogatepass") for t in texts]):
            found, ends = features(part)
            index += np.split(found, ends[:-1])
            words.append(np.diff(np.r_[0, ends]))
        own = [np.unique(i, return_counts=True) for i in index]
        return {"doc_id": ids, "domain": domains, "index": [i for i, _ in own], "times": [t for _, t in own],
                "source": source_features(sources), "length": length_features(np.concatenate(words))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source").join(F.broadcast(sample), "doc_id")
    schema = "doc_id long, domain int, index array<long>, times array<long>, source long, length long"
    rows = by_piece(rows.select("doc_id", "text", "source", "domain"), extract, schema).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Classifier(np.zeros((FEATURES, size)), np.zeros(size))
    lists = rows["index"].combine_chunks(), rows["times"].combine_chunks()
    count = np.diff(np.asarray(lists[0].offsets))
    doc = np.repeat(np.arange(len(count)), count)
    index, times = (np.asarray(x.flatten()) for x in lists)
    total = np.maximum(np.bincount(doc, times, len(count)), 1)
    doc = np.r_[doc, np.arange(len(count)), np.arange(len(count))]
    value = np.r_[times / np.sqrt(total[doc[: len(times)]]), np.full(2 * len(count), 1 / SOURCE)]
    index = np.r_[index, np.asarray(rows["source"]), np.asarray(rows["length"])]
    order = np.argsort(doc, kind="stable")
    return Classifier(*_fit(index[order], value[order], doc[order], np.asarray(rows["domain"]), size))


def _fit(index: np.ndarray, value: np.ndarray, doc: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by adaptive gradient steps over all rows."""
    wanted = np.eye(size)[label]
    rows = len(label)
    used, place = np.unique(index, return_inverse=True)
    weights, bias = np.zeros((len(used), size)), np.log((wanted.sum(0) + 1) / (rows + size))
    first, second = np.zeros((len(used) + 1, size)), np.zeros((len(used) + 1, size))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for step in range(1, PASSES + 1):
        logits = np.add.reduceat(weights[place] * value[:, None], starts) + bias
        miss = (softmax(logits) - wanted) / rows
        part = value[:, None] * miss[doc]
        slope = np.stack([np.bincount(place, part[:, k], len(used)) for k in range(size)], axis=1) + SHRINK * weights / rows
        slope = np.vstack([slope, miss.sum(0)])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights -= RATE * move[:-1]
        bias -= RATE / 4 * move[-1]
    out = np.zeros((FEATURES, size))
    out[used] = weights
    return out, bias


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, n_words, posteriors) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def work(ids: list, texts: list[str], sources: list) -> dict[str, list]:
        found, words = sent.value.posteriors(texts, sources)
        return {"doc_id": ids, "n_words": words, "posteriors": list(found)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return by_piece(rows, work, "doc_id long, n_words long, posteriors array<double>")


@dataclass
class Rates:
    """Rates as the steps that lead to them: from 1 on, a step against each gradient and back to what is allowed."""

    steps: list[np.ndarray]
    most: float

    def of(self, posteriors: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rate of each row; with ``ahead`` the point that the last step's momentum leads to, where the next gradient is taken."""
        rate = point = np.full(len(posteriors), min(1.0, self.most))
        for number, step in enumerate(self.steps):
            new = np.clip(point - posteriors @ step, 0.0, self.most)
            point = new + number / (number + 3) * (new - rate)
            rate = new
        return point if ahead else rate


def fit_rates(members: DataFrame, targets: Sequence[float], relative: bool = False, most: float = float("inf")) -> Rates:
    """Nonnegative rates, at most ``most``, of documents (n_words, posteriors) by least squares.

    With them the expected words of each domain come to ``targets``: shares of all
    words, or with ``relative`` multiples of what the domain has. Gradient steps are
    taken in the metric of the documents' words, so that a rate changes by its
    posteriors alone. A step is one pass over the members that sums as many numbers as
    there are domains; the rates are worked out anew from the steps' few numbers in
    every pass, so that nothing is kept between passes and a lost executor costs nothing else.
    """
    size = len(targets)

    def totals(work: Callable[[np.ndarray, np.ndarray], np.ndarray], count: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(count)
            for batch in batches:
                if batch.num_rows:
                    words = np.asarray(batch["n_words"]).astype(np.float64)
                    own = np.asarray(batch["posteriors"].flatten()).reshape(-1, size)
                    sums += work(words[:, None] * own, own)
            yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int64()), pa.array(sums)], names=["k", "s"])

        found = members.select("n_words", "posteriors").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))
        out = np.zeros(count)
        for k, s in found.collect():
            out[k] = s
        return out

    def expected(rates: Rates) -> np.ndarray:
        """Words of each domain at the rates, and at the point ahead of them."""
        work = lambda weighted, own: np.r_[rates.of(own) @ weighted, rates.of(own, True) @ weighted]
        return totals(work, 2 * size).reshape(2, size)

    # Words of each domain at rate 1, and of each two domains together.
    first = totals(lambda weighted, own: np.r_[weighted.sum(0), (weighted.T @ own).ravel()], size + size * size)
    present, both = first[:size], first[size:].reshape(size, size)
    words = present.sum()
    if not words or not most:
        return Rates([], most)
    wanted = np.asarray(targets, float) * (present if relative else words)
    # A domain's miss counts by its own curvature, so that small domains move as fast as large ones; the largest
    # curvature that is left gives a step that never overshoots.
    scale = 1 / np.maximum(np.diag(both), 1e-300)
    curve = np.linalg.eigvalsh(np.sqrt(scale)[:, None] * both * np.sqrt(scale))[-1]
    steps: list[np.ndarray] = []
    at, ahead = expected(Rates(steps, most))
    for _ in range(STEPS):
        if np.abs(at - wanted).max() < MISS * words:
            break
        steps.append((ahead - wanted) * scale / curve)
        at, ahead = expected(Rates(steps, most))
    return Rates(steps, most)


def with_rates(members: DataFrame, rates: Rates) -> DataFrame:
    """Members with their rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch["posteriors"].flatten()).reshape(batch.num_rows, -1)
            yield batch.append_column("rate", pa.array(rates.of(own)))

    return members.mapInArrow(run, "doc_id long, n_words long, posteriors array<double>, rate double")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Sequence[float]) -> DataFrame:
    """(doc_id, n_words, one posterior for each domain, rate) of every document; ``targets`` are shares of all words.

    A rate says how often a document is to be used on average; it depends on the
    document's posteriors only. A null or empty text has no words, its rate is that
    of its posteriors all the same. Repeated rows give repeated rows, an empty table
    none; columns other than doc_id, text and source are not read.
    """
    members = pin(memberships(docs, fit_domains(docs, labels)), "memberships")
    rated = with_rates(members, fit_rates(members, targets))
    return rated.select("doc_id", "n_words", *(F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate")


def sampled(docs: DataFrame, labels: DataFrame, targets: Sequence[float]) -> DataFrame:
    """The rows of ``docs`` that are kept when each is with its rate as probability, by a hash of its doc_id.

    A row without an id goes by a hash of its text. A null text is an empty one. ``targets`` are
    multiples of each domain's words, at most 1. All columns stay; an empty table gives none.
    """
    classifier = fit_domains(docs, labels)
    rates = fit_rates(pin(memberships(docs, classifier), "memberships"), targets, relative=True, most=1.0)
    sent = docs.sparkSession.sparkContext.broadcast((classifier, rates))
    schema, places = docs.schema, [docs.columns.index(c) for c in ("doc_id", "text", "source")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rate = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, texts, sources = (part.column(p).to_pylist() for p in places)
                own, _ = known.posteriors([t or "" for t in texts], sources)
                keys = [zlib.crc32((t or "").encode()) if i is None else i for i, t in zip(ids, texts)]
                chance = mix(np.array(keys, np.int64).view(np.uint64) + DRAW) / 2.0**64
                yield part.filter(pa.array(chance < rate.of(own)))

    return docs.mapInArrow(keep, schema)
