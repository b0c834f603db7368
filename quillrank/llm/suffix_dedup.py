"""Remove text that stands earlier: repeated strings of a fixed length, found by deep-shallow suffix sorting."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import pieces, record_batch
from quillrank.llm.jaccard_join import groups
from quillrank.llm.shingles import _powers, chunks, mix
from quillrank.operators import ordered
from quillrank.session import pin, scratch_path

#: Bytes of a string that is removed where it stands again.
LENGTH = 100
#: Bytes of an anchor: the string of that length with the smallest hash within ``LENGTH`` bytes.
ANCHOR = 40
#: Bytes up to which suffixes are sorted by multikey quicksort; tries order those that are still equal.
SHALLOW = 16
#: Multikey quicksort hands parts of this size or less to one sort for all of them.
SMALL = 4096
#: Contexts that one anchor may have in a task: as many as a task has on average, within these bounds. The strings of
#: more are dealt out singly.
LEAST, MOST = 256, 8_000
#: Anchors that a task groups at a time, about.
ENTRIES = 500_000


# Sorting


def words_at(data: np.ndarray, starts: np.ndarray, depth: int, length: int) -> np.ndarray:
    """The 8 bytes at ``depth`` of each suffix as a number that sorts like them; bytes from ``length`` on count as 0."""
    every = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    word = every[starts + depth].astype(np.uint64)
    if depth + 8 > length:
        cut = np.uint64(8 * (depth + 8 - length))
        word = (word >> cut) << cut
    return word


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first ``length`` bytes, and the number of each one's group of equals, in that order.

    ``data`` must reach 8 bytes beyond every suffix's end. Shallow: three-way
    multikey quicksort on 8-byte words. Deep: suffixes that agree on ``SHALLOW``
    bytes form the leaves of blind tries, which are grown for all groups together:
    a node skips to the first word in which its leaves differ.
    """
    data = np.ascontiguousarray(data)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    if not len(starts):
        return order, group
    depth = 0
    while depth < min(SHALLOW, length):
        order, group = _multikey(words_at(data, starts[order], depth, length), order, group)
        depth += 8
    return _tries(data, starts, order, group, depth, length)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any column differs from the row before; the first row counts as a change."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _multikey(key: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each group by its keys: three-way partitions around a middle key, small parts together at the end."""
    cuts = np.r_[np.flatnonzero(_changes(group)), len(group)]
    place, part, fresh = np.arange(len(order)), group.copy(), int(group[-1]) + 1
    stack = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > SMALL]
    while stack:
        a, b = stack.pop()
        own = key[place[a:b]]
        some = own[:: max(1, (b - a) // 63)]
        middle = np.partition(some, len(some) // 2)[len(some) // 2]
        side = (own > middle).astype(np.int8) - (own < middle)
        place[a:b] = place[a:b][np.argsort(side, kind="stable")]
        below = a + int((side < 0).sum())
        above = below + int((side == 0).sum())
        for start, end in ((a, below), (below, above), (above, b)):
            part[start:end] = fresh
            fresh += 1
            if start != below and end - start > SMALL:
                stack.append((start, end))
    # Numbers that rise with the place let one sort finish all parts.
    place = place[np.lexsort((key[place], np.cumsum(_changes(part))))]
    key = key[place]
    return order[place], np.cumsum(_changes(key, group)) - 1


def _tries(data: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Blind tries over the groups of two and more suffixes, level by level."""
    split = _changes(group)
    at = np.flatnonzero(np.bincount(group)[group] > 1)
    node = group[at]
    # A leaf's words below the shallow depth; leaves of a node follow each other.
    leaf = np.stack([words_at(data, starts[order[at]], d, length) for d in range(depth, length, 8)] or [node], axis=1)
    while len(at):
        first = _changes(node)
        leader = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        unlike = leaf != leaf[leader]
        column = np.where(unlike.any(1), unlike.argmax(1), leaf.shape[1])
        # The node's branch is the first word in which a leaf differs; without one all its leaves are equal.
        branch = np.minimum.reduceat(column, np.flatnonzero(first))[np.cumsum(first) - 1]
        live = branch < leaf.shape[1]
        at, leaf, node, branch = at[live], leaf[live], node[live], branch[live]
        if not len(at):
            break
        word = leaf[np.arange(len(at)), branch]
        turn = np.lexsort((word, node))
        order[at], leaf, word = order[at[turn]], leaf[turn], word[turn]
        new = _changes(word, node)
        split[at] |= new
        child = np.cumsum(new) - 1
        many = np.bincount(child)[child] > 1
        at, leaf, node = at[many], leaf[many], child[many]
    return order, np.cumsum(split) - 1


# Anchors


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``LENGTH`` bytes by their anchors: the anchor's hash, text, first string and number of each run.

    A run is the strings in a row that have one anchor. Equal strings have equal
    anchors, so that only runs with one hash can have strings in common.
    """
    start, parts = 0, []
    for part in chunks(texts):
        anchor, own, first, number = _runs(part)
        parts.append((anchor, own + start, first, number))
        start += len(part)
    return tuple(map(np.concatenate, zip(*parts))) if parts else _runs([])


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none.astype(np.uint64), none, none, none
    up, down = _powers.upto(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTES[raw]) * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(raw) - ANCHOR + 1])
    # The place in the low half makes the leftmost of equals the anchor, in every copy of a string alike.
    place = np.arange(len(hashes), dtype=np.uint64)
    least = _smallest((hashes >> np.uint64(32) << np.uint64(32)) | place, LENGTH - ANCHOR + 1)
    start = np.arange(len(least))
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = start + LENGTH <= ends[text]
    first = np.flatnonzero(_changes(anchor, text, inside))
    number = np.diff(np.r_[first, len(least)])
    use = inside[first]
    first, number = first[use], number[use]
    return hashes[anchor[first]], text[first], first - (ends - sizes)[text[first]], number


#: Unlike for words, letters of either case are different bytes.
_BYTES = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# Stages


def repeated(docs: DataFrame, parts: int) -> DataFrame:
    """(key, firsts, numbers, anchors): the runs of each document whose anchor stands more than once.

    Runs travel packed, a row for each part of the anchors and piece of the documents,
    and back to a row for each part of the documents; texts that a piece has twice
    are left out, for they are copies.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in pieces(batches):
            own = dict(zip(reversed(texts), reversed(keys)))
            anchor, text, first, number = runs([t.encode("utf-8", "surrogatepass") for t in own])
            if not len(anchor):
                continue
            part = (mix(anchor) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            columns = [c[order] for c in (anchor, text.astype(np.uint32), first.astype(np.uint32), number.astype(np.uint8))]
            cuts = np.r_[np.flatnonzero(_changes(part[order])), len(part)]
            names = np.fromiter(own.values(), np.int64, len(own))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                owner, place = np.unique(columns[1][a:b], return_inverse=True)
                place = place.astype(np.uint16 if len(owner) <= 1 << 16 else np.uint32)
                packed = (columns[0][a:b], names[owner], place, columns[2][a:b], columns[3][a:b])
                rows.append((int(part[order[a]]), *(c.tobytes() for c in packed)))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 5])]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "anchors", "owners", "places", "firsts", "numbers"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for _, anchors, owners, places, firsts, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                kind = np.uint16 if len(places) * 4 == len(anchors) else np.uint32
                owner = np.frombuffer(owners, np.int64)[np.frombuffer(places, kind)]
                held.append((np.frombuffer(anchors, np.int64), owner, np.frombuffer(firsts, np.uint32), np.frombuffer(numbers, np.uint8)))
        if not held:
            return
        anchor, owner, first, number = map(np.concatenate, zip(*held))
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        keep = order[np.r_[False, same] | np.r_[same, False]]
        keep = keep[np.lexsort((first[keep], owner[keep]))]
        anchor, owner, first, number = (c[keep] for c in (anchor, owner, first, number))
        part = (mix(owner.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        anchor, owner, first, number, part = (c[order] for c in (anchor, owner, first, number, part))
        if len(owner):
            cuts = np.r_[np.flatnonzero(_changes(part)), len(part)]
            rows = [(int(part[a]), *(c[a:b].tobytes() for c in (anchor, owner, first, number))) for a, b in zip(cuts[:-1], cuts[1:])]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "anchors", "owners", "firsts", "numbers"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row[1:] for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if not held:
            return
        kinds = np.int64, np.int64, np.uint32, np.uint8
        anchor, owner, first, number = (np.frombuffer(b"".join(c), k) for c, k in zip(zip(*held), kinds))
        order = np.argsort(owner, kind="stable")
        anchor, owner, first, number = (c[order] for c in (anchor, owner, first, number))
        cuts = np.r_[np.flatnonzero(_changes(owner)), len(owner)]
        for start in range(0, len(cuts) - 1, 1000):
            rows = [(int(owner[a]), *(c[a:b].tobytes() for c in (first, number, anchor)))
                    for a, b in zip(cuts[start:-1][:1000], cuts[start + 1 :][:1000])]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *[pa.binary()] * 3])]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "firsts", "numbers", "anchors"])

    packed = docs.mapInArrow(pack, "part int, anchors binary, owners binary, places binary, firsts binary, numbers binary")
    found = packed.repartition(parts, "part").mapInArrow(shared, "part int, anchors binary, owners binary, firsts binary, numbers binary")
    return found.repartition(parts, "part").mapInArrow(gathered, "key long, firsts binary, numbers binary, anchors binary")


CONTEXT = "anchor long, n1 long, n2 long, key long, first int, number int, bytes binary"
REPEAT = "key long, first int, number int"


def contexts(docs: DataFrame) -> DataFrame:
    """The runs of ``docs`` (key, text, firsts, numbers, anchors), rising keys in a task, with the bytes that their strings cover.

    ``n1, n2`` are 128 bits that name the bytes. A context that a task has met before
    is a repeat of that and comes without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int, int]] = set()
        for batch in batches:
            for lists in pieces([batch]):
                out = []
                for key, text, firsts, numbers, anchors in zip(*lists):
                    raw = text.encode("utf-8", "surrogatepass")
                    first, number, anchor = (
                        np.frombuffer(x, k).tolist() for x, k in ((firsts, np.uint32), (numbers, np.uint8), (anchors, np.int64)))
                    for h, s, n in sorted(zip(anchor, first, number), key=lambda r: r[1]):
                        held = raw[s : s + n - 1 + LENGTH]
                        name = struct.unpack("<qq", hashlib.blake2b(held, digest_size=16).digest())
                        new = (h, *name) not in met
                        met.add((h, *name))
                        out.append((h, *name, key, s, n, held if new else None))
                yield record_batch(out, CONTEXT)

    return docs.mapInArrow(run, CONTEXT)


def sorted_repeats(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, first, number) of the strings in a batch of contexts that are equal to an earlier one in it."""
    column = batch["bytes"]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: batch.num_rows + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    data = np.r_[data[offsets[0] : offsets[-1]], np.zeros(16, np.uint8)]
    number, key, first = (np.asarray(batch[c]).astype(np.int64) for c in ("number", "key", "first"))
    row = np.repeat(np.arange(len(number)), number)
    step = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    order, group = sort_suffixes(data, (offsets[:-1] - offsets[0])[row] + step)
    # Of equals all but the earliest go.
    key, first = key[row[order]], first[row[order]] + step[order]
    turn = np.lexsort((first, key, group))
    again = turn[~_changes(group[turn])]
    key, first = key[again], first[again]
    turn = np.lexsort((first, key))
    key, first = key[turn], first[turn]
    head = np.flatnonzero(_changes(key, first - np.arange(len(first))))
    length = np.diff(np.r_[head, len(key)])
    return pa.RecordBatch.from_arrays(
        [pa.array(key[head], pa.int64()), pa.array(first[head], pa.int32()), pa.array(length, pa.int32())], names=["key", "first", "number"])


def by_anchor(rows: DataFrame) -> DataFrame:
    """Repeats among the contexts of each anchor, the strings of many anchors sorted at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["anchor"]):
            same = ~_changes(*(np.asarray(batch[c]) for c in ("anchor", "n1", "n2")))
            # Equal contexts follow each other, the earliest first.
            yield batch.filter(pa.array(same)).select(["key", "first", "number"])
            yield sorted_repeats(batch.filter(pa.array(~same)))

    order = ["anchor", "n1", "n2", "key", "first"]
    return rows.repartition("anchor").sortWithinPartitions(*order).mapInArrow(run, REPEAT)


def singly(rows: DataFrame) -> DataFrame:
    """Repeats among contexts whose anchors have too many for a task: strings are sorted in the pieces of each task first.

    The strings left there are dealt out one by one, and sorted with their equals.
    """
    schema = f"string long, {REPEAT}, bytes binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                repeats = [tuple(r.values()) for r in sorted_repeats(part).to_pylist()]
                gone = {(key, first + k) for key, first, number in repeats for k in range(number)}
                out = [(None, *r, None) for r in repeats]
                for key, first, number, held in zip(*(part[c].to_pylist() for c in ("key", "first", "number", "bytes"))):
                    for k in range(number):
                        if (key, first + k) not in gone:
                            string = held[k : k + LENGTH]
                            name = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                            out.append((name, key, first + k, 1, string))
                yield record_batch(out, schema)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["string"]):
            yield sorted_repeats(batch)

    found = pin(rows.mapInArrow(local, schema), "strings")
    left = found.where("bytes IS NOT NULL").repartition("string").sortWithinPartitions("string")
    return found.where("bytes IS NULL").select("key", "first", "number").union(left.mapInArrow(again, REPEAT))


def cut(raw: bytes, repeats: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without its repeated strings, the bytes removed, and in how many spans."""
    kept, end, removed, spans, last = [], 0, 0, 0, -1
    for first, number in sorted(repeats):
        stop = first + number - 1 + LENGTH
        if first > last:
            kept.append(raw[end:first])
            spans += 1
            removed += stop - first
        elif stop > last:
            removed += stop - last
        end = last = max(last, stop)
    kept.append(raw[end:])
    return b"".join(kept), removed, spans


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (key, text) that aren't copies of an earlier one, as a table bucketed by key, and their repeats (key, repeats).

    Keys are distinct; a smaller key stands earlier.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = docs.withColumn("sha", F.sha2("text", 256))
    rank = pin(hashed.groupBy("sha").agg(F.min("key").alias("key")).select("key"), "first-copies")
    # Both steps that need the texts by key find them dealt out; they are shuffled once.
    name = f"texts_{uuid.uuid4().hex}"
    table = docs.repartition(width, "key").join(rank, "key", "left_semi")
    table.write.bucketBy(width, "key").sortBy("key").option("path", scratch_path(spark, name)).saveAsTable(name)
    texts = spark.table(name)

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(width, int(size * 2 / (LENGTH - ANCHOR + 2)) // ENTRIES)
    marked = repeated(texts.select("key", "text"), parts)
    joined = texts.select("key", "text").join(marked.hint("merge"), "key").sortWithinPartitions("key")
    found = pin(contexts(joined), "contexts")
    rows = found.where("bytes IS NOT NULL")
    counts = rows.groupBy("anchor").count()
    hot = max(LEAST, min(MOST, rows.count() // width))
    hot_anchors = pin(counts.where(F.col("count") > hot).select("anchor"), "hot-anchors")
    repeats = found.where("bytes IS NULL").select("key", "first", "number")
    repeats = repeats.union(by_anchor(rows.join(hot_anchors, "anchor", "left_anti")))
    repeats = repeats.union(singly(rows.join(hot_anchors, "anchor", "left_semi")))
    return texts, repeats.groupBy("key").agg(F.collect_list(F.struct("first", "number")).alias("repeats"))


def keyed(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a distinct key that rises with doc_id: doc_id itself, or else the place in the order of doc_id and text."""
    same = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    docs = docs.withColumn("text", text)
    if not same.limit(1).count():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    return ordered.number_rows(docs, ["doc_id", "text"], name="key")


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    Removed is every byte of a string of ``LENGTH`` bytes that also starts earlier, in
    a document with a smaller doc_id or further up in the same one, as the input
    stands; strings don't cross documents. Texts are UTF-8 bytes, a null text is
    empty. Rows that share a doc_id count as documents in the order of their texts,
    a null doc_id as the smallest. An empty table gives no rows; columns other than doc_id and text
    are not read. Exact: strings are compared byte by byte, whole texts and contexts by
    256 and 128 bits of cryptographic hashes.
    """
    docs = keyed(docs.select("doc_id", "text"), F.coalesce("text", F.lit("")))
    texts, repeats = find_repeats(docs.select("key", "text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies, spans in pieces(batches):
            out = []
            for key, body, own in zip(keys, bodies, spans):
                kept, removed, number = cut(body.encode("utf-8", "surrogatepass"), [(r["first"], r["number"]) for r in own])
                out.append((key, removed, number, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "n_removed", "n_spans", "kept"])

    changed = texts.join(repeats.hint("merge"), "key").select("key", "text", "repeats")
    changed = changed.mapInArrow(finish, "key long, n_removed long, n_spans long, kept string")
    size = F.octet_length("text").cast("long")
    rows = docs.select("doc_id", "key", size.alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    first = texts.select("key", F.lit(True).alias("first"))
    rows = rows.join(first, "key", "left").join(changed, "key", "left")
    copy = F.col("first").isNull() & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the text that ``removed_spans`` removes; documents left without any go.

    Characters of which a byte is removed go too. All columns stay; texts that don't
    change, nulls among them, stay as they are.
    """
    columns = docs.columns
    others = F.struct(*(F.col(f"`{c}`") for c in columns if c != "text"))
    held = docs.select("doc_id", "text", others.alias("others"), F.col("text").isNull().alias("none"))
    held = keyed(held, F.coalesce("text", F.lit(""))).select("key", "text", "others", "none")
    texts, repeats = find_repeats(held)
    schema = texts.join(repeats, "key").select("text", "others", "none").schema

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, spans = batch["text"].to_pylist(), batch["repeats"].to_pylist()
            new = []
            for body, own in zip(bodies, spans):
                if own:
                    kept, _, _ = cut(body.encode("utf-8", "surrogatepass"), [(r["first"], r["number"]) for r in own])
                    body = kept.decode("utf-8", "ignore") or None
                new.append(body)
            out = pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch["others"], batch["none"]], names=["text", "others", "none"])
            yield out.filter(pa.array([t is not None for t in new]))

    done = texts.join(repeats.hint("merge"), "key", "left").select("text", "others", "none", "repeats").mapInArrow(finish, schema)
    # Copies shorter than a string aren't repeats.
    short = held.where(F.octet_length("text") < LENGTH).join(texts.select("key"), "key", "left_anti").select("text", "others", "none")
    text = F.when(~F.col("none"), F.col("text"))
    return done.union(short).select(*(text.alias("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in columns))
