"""Documents whose sets of five-word shingles are alike: tiles within size bands, bitmap bounds, exact intersection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import shingles
from quillrank.llm.common import components, pieces
from quillrank.session import pin

#: Two sets link when 9 * shared >= 4 * (size + size): that is shared / united >= 0.8.
SHARED, BOTH = 9, 4
#: Documents with one token that are paired at once; more of them go to tiles.
FEW = 16
#: Documents of a tile; a larger group gets several, and its first tile meets all others.
TILE = 512
#: Bits for each element in the bitmaps of documents that many others meet; for the others one is enough.
WIDE = 4
#: Shingles at most that are ordered behind all others for being frequent. The order changes work, never results.
FREQUENT = 65_536
#: Entries that a task groups at a time, about.
ENTRIES = 500_000


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with so many shared elements link."""
    return SHARED * shared >= BOTH * (a + b)


def prefix(n: int) -> int:
    """How many of a set's first elements, in one order for all, hold one of any set that it links with."""
    return n - (4 * n + 4) // 5 + 1


class Bitmaps:
    """Bitmaps of documents, each as wide as its set is large."""

    def __init__(self, bits: pa.Array):
        offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        data = np.frombuffer(bits.buffers()[2] or b"", np.uint8)[: offsets[-1] if len(offsets) else 0]
        self.first, self.words = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8
        self.data = np.frombuffer(data[offsets[0] :].tobytes(), np.uint64)

    def unlike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits by which the bitmaps of pairs differ, the wider one folded to the width of the other."""
        out = np.zeros(len(a), np.int64)
        code = self.words[a] * (1 << 32) + self.words[b]
        for value in np.unique(code):
            at = np.flatnonzero(code == value)
            wide, narrow = int(value >> 32), int(value & 0xFFFFFFFF)
            width = min(wide, narrow)
            for start in range(0, len(at), step := max(1, (1 << 18) // max(wide, narrow))):
                part = at[start : start + step]
                left, right = (self.data[self.first[x][:, None] + np.arange(n)] for x, n in ((a[part], wide), (b[part], narrow)))
                left, right = (np.bitwise_or.reduce(m.reshape(len(m), -1, width), axis=1) for m in (left, right))
                out[part] = np.bitwise_count(left ^ right).sum(1)
        return out


def near(group: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs in a group whose sizes can link; sizes rise within a group."""
    a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, step = np.arange(len(group)), 0
    while len(live):
        step += 1
        live = live[live + step < len(group)]
        other = live + step
        # A pair that is too far apart ends its first one's turn.
        live = live[(group[live] == group[other]) & (4 * sizes[other] <= 5 * sizes[live])]
        a_all.append(live)
        b_all.append(live + step)
    return np.concatenate(a_all), np.concatenate(b_all)


class Rows:
    """Documents of tiles, by group and size: group, id, size and bitmap of each."""

    def __init__(self, group: np.ndarray, ids: np.ndarray, sizes: np.ndarray, bits: pa.Array):
        self.group, self.ids, self.sizes, self.maps = group, ids, sizes, Bitmaps(bits)

    def close(self, skip: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one group, of sizes that can link, whose bitmaps leave enough room to be shared."""
        a, b = near(self.group, self.sizes)
        use = ~skip(a, b) & (self.ids[a] != self.ids[b])
        a, b = a[use], b[use]
        both = self.sizes[a] + self.sizes[b]
        good = linked((both - self.maps.unlike(a, b)) // 2, self.sizes[a], self.sizes[b])
        return a[good], b[good]


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs, taken in their order, that connect what is not connected yet."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (x := root(x)) != (y := root(y)):
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return np.array(out, np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that no group, rows with equal keys one after the other, lies in two."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.concat_batches([left, batch])
        last = np.ones(batch.num_rows, bool)
        for key in keys:
            column = np.asarray(batch[key])
            last &= column == column[-1]
        start = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if start:
            yield batch.slice(0, start)
        left = batch.slice(start)
    if left is not None:
        yield left


def describe(docs: DataFrame) -> DataFrame:
    """A row for each document with size, digest and bitmaps of its set, and rows with the counts of repeated shingles."""
    schema = "doc_id long, n long, d1 long, d2 long, bits binary, wide binary, shingle long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            rows, own = [], {}
            for found in shingles.sets(texts):
                name = shingles.digest(found)
                own.setdefault(name, found)
                rows.append((len(found), *name, shingles.bitmap(found), shingles.bitmap(found, WIDE)))
            every = np.sort(np.concatenate([*own.values()]))
            at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            times = np.diff(np.r_[at, len(every)])
            often = times >= 3
            none, more = [None] * int(often.sum()), [None] * len(ids)
            columns = [ids + none, *([r[k] for r in rows] + none for k in range(5)),
                       more + every[at[often]].view(np.int64).tolist(), more + times[often].tolist()]
            kinds = [pa.binary() if k in (4, 5) else pa.int64() for k in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.replace(",", "").split()[::2])

    return docs.mapInArrow(run, schema)


def entries(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """(token, doc_id, often): the shingles of each document's prefix that more than one document has in its own.

    In the order of tokens, those in ``frequent``, rarest first, stand behind all others.
    Entries travel packed, a row for each part of the tokens and piece of the
    documents. Frequent tokens are known to be shared, so they aren't gathered; they
    have ``often``.
    """
    place = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[place], place))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        turn = 0
        for ids, texts in pieces(batches):
            seen, tokens, owners = set(), [], []
            for doc_id, found in zip(ids, shingles.sets(texts)):
                if doc_id is None or not len(found) or (name := (len(found), *shingles.digest(found))) in seen:
                    continue
                seen.add(name)
                want = prefix(len(found))
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = known[at] == found
                    rare = found[~often]
                    if len(rare) < want:
                        rare = np.r_[rare, found[often][np.argsort(rank[at[often]])]]
                    found = rare
                tokens.append(found[:want])
                owners.append(np.full(want, doc_id, np.int64))
            if not tokens:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            often = np.isin(token, known) if len(known) else np.zeros(len(token), bool)
            part = (token % np.uint64(parts)).astype(np.int64)
            # Frequent tokens go anywhere, so that none of them fills a part.
            part[often] = parts + (turn + int(owner[0] % parts)) % parts
            turn += 1
            order = np.argsort(part, kind="stable")
            token, owner, part = token[order], owner[order], part[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                names, place = np.unique(owner[a:b], return_inverse=True)
                place = place.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
                rows.append((int(part[a] % parts), bool(part[a] >= parts), *(x.tobytes() for x in (token[a:b], names, place))))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.bool_(), *[pa.binary()] * 3))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "often", "tokens", "names", "places"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(token: np.ndarray, owner: np.ndarray, often: bool) -> pa.RecordBatch:
            columns = [pa.array(token), pa.array(owner), pa.array(np.full(len(token), often))]
            return pa.RecordBatch.from_arrays(columns, names=["token", "doc_id", "often"])

        tokens, owners = [], []
        for batch in batches:
            for _, often, token, names, places in zip(*(c.to_pylist() for c in batch.columns)):
                token = np.frombuffer(token, np.int64)
                kind = np.uint16 if len(places) == 2 * len(token) else np.uint32
                owner = np.frombuffer(names, np.int64)[np.frombuffer(places, kind)]
                if often:
                    yield rows(token, owner, True)
                else:
                    tokens.append(token)
                    owners.append(owner)
        if tokens:
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            same = token[1:] == token[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            yield rows(token[keep], owner[keep], False)

    packed = docs.mapInArrow(pack, "part int, often boolean, tokens binary, names binary, places binary")
    return packed.repartition(parts, "part").mapInArrow(shared, "token long, doc_id long, often boolean")


def few(rows: DataFrame) -> DataFrame:
    """(a, b, token, n): pairs of documents (token, rep, n) with a token that few have, if their sizes can link.

    Documents of a token that more have come as a with that token and no b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["token"]):
            token, rep, n = (np.asarray(batch[c]) for c in ("token", "rep", "n"))
            fresh = np.r_[True, (token[1:] != token[:-1]) | (rep[1:] != rep[:-1]) | (n[1:] != n[:-1])]
            token, rep, n = token[fresh], rep[fresh], n[fresh]
            group = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
            small = np.bincount(group)[group] <= FEW
            a, b = near(group[small], n[small])
            a, b = np.flatnonzero(small)[a], np.flatnonzero(small)[b]
            a, b = a[rep[a] != rep[b]], b[rep[a] != rep[b]]
            left, right = np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
            pair = np.unique(np.stack([left, right], axis=1), axis=0)
            none = [None] * len(pair)
            columns = (np.r_[pair[:, 0], rep[~small]], pair[:, 1].tolist() + [None] * int((~small).sum()),
                       none + token[~small].tolist(), none + n[~small].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "token", "n"])

    ordered = rows.repartition("token").sortWithinPartitions("token", "n", "rep")
    return ordered.mapInArrow(run, "a long, b long, token long, n long")


def likely(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule a link out."""
    one = of.where("doc_id = rep").select("rep", "n", "bits")
    ends = pairs
    for side in ("a", "b"):
        ends = ends.join(one.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, n = batch.num_rows, [np.asarray(batch[c]) for c in ("n_a", "n_b")]
            maps = Bitmaps(pa.concat_arrays([batch["bits_a"], batch["bits_b"]]))
            unlike = maps.unlike(np.arange(size), size + np.arange(size))
            yield batch.select(["a", "b"]).filter(pa.array(linked((n[0] + n[1] - unlike) // 2, *n)))

    return ends.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long").distinct()


def tiled(rows: DataFrame) -> DataFrame:
    """Deal the documents of each token (token, rep, n) to tiles; ``pivot`` marks those of a first tile in another."""
    counts = rows.groupBy("token").count().where("count > 1")
    tiles = counts.select("token", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    dealt = rows.join(tiles, "token")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles").cast("long")).cast("int"))
    to = F.when(F.col("tile") == 0, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    met = dealt.withColumn("to", F.explode(to))
    return met.select("token", F.col("to").alias("tile"), "rep", "n", (F.col("to") != F.col("tile")).alias("pivot"),
                      (F.col("tiles") > 1).alias("part"))


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "rep")


def _grouped(batch: pa.RecordBatch, *keys: str) -> Rows:
    change = np.zeros(batch.num_rows, bool)
    for key in keys:
        column = np.asarray(batch[key])
        change[1:] |= column[1:] != column[:-1]
    return Rows(np.cumsum(change), np.asarray(batch["rep"]), np.asarray(batch["n"]), batch["bits"])


def first_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, token): of the pairs in each tile (as from ``tiled``, with bits) that bitmaps don't rule out, those that connect it.

    Rows with a token and no pair name tokens that have more pairs than those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["token", "tile"]):
            tile = _grouped(batch, "token", "tile")
            pivot = np.asarray(batch["pivot"].to_numpy(zero_copy_only=False))
            a, b = tile.close(lambda x, y: pivot[x] & pivot[y])
            left, right = np.minimum(tile.ids[a], tile.ids[b]), np.maximum(tile.ids[a], tile.ids[b])
            # Small ids first, so that the tiles of one group of documents choose the same pairs.
            order = np.lexsort((right, left, tile.group[a]))
            a, b, left, right = a[order], b[order], left[order], right[order]
            kept = spanning(*(np.where(left[:, None] == tile.ids[a][:, None], np.c_[a, b], np.c_[b, a])).T) if len(a) else a
            token = np.asarray(batch["token"])
            more = np.bincount(tile.group[a], minlength=tile.group[-1] + 1) > np.bincount(tile.group[a[kept]], minlength=tile.group[-1] + 1)
            more |= np.bincount(tile.group, np.asarray(batch["part"].to_numpy(zero_copy_only=False)), tile.group[-1] + 1) > 0
            named = token[np.searchsorted(tile.group, np.flatnonzero(more))]
            none = [None] * len(named)
            columns = left[kept].tolist() + none, right[kept].tolist() + none, [None] * len(kept) + named.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "token"])

    return _sorted(rows, "token", "tile").mapInArrow(run, "a long, b long, token long")


def other_pairs(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b): of the documents (token, rep, n, component) all pairs in two components that bitmaps don't rule out.

    The largest component of a token is only met by the others' documents, dealt to tiles.
    """
    sizes = rows.groupBy("token", "component").count()
    most = sizes.groupBy("token").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("all"))
    most = most.where(F.col("all") > F.col("m.count"))
    most = most.select("token", F.col("m.component").alias("main"),
                       F.ceil((F.col("all") - F.col("m.count")) / TILE).cast("int").alias("tiles"))
    dealt = rows.join(most, "token").withColumn("asks", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("rep"), F.col("tiles").cast("long")).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("asks"), own).otherwise(F.lit(-1)))
    # Those met come in shares of a tile's size too, so that no task gets a whole group.
    shares = F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("met") / TILE)))
    met = rows.groupBy("token").agg(F.count("*").alias("met"))
    dealt = dealt.join(met, "token").withColumn("share", shares.cast("int"))
    lists = F.greatest(F.lit(1), F.ceil(F.col("met") / TILE)).cast("int")
    columns = ["rep", "n", "component"]
    every = F.explode(F.sequence(F.lit(0), lists - 1)).alias("share")
    asking = dealt.where("asks").select("token", F.col("own").alias("tile"), every, *columns, F.lit(True).alias("asks"))
    turns = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    asked = dealt.select("token", turns, "share", *columns, F.lit(False).alias("asks"))
    together = asking.union(asked).join(bits, ["rep", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["token", "tile", "share"]):
            tile = _grouped(batch, "token", "tile", "share")
            component = np.asarray(batch["component"])
            asks = np.asarray(batch["asks"].to_numpy(zero_copy_only=False))
            a, b = tile.close(lambda x, y: (component[x] == component[y]) | (asks[x] == asks[y]))
            left, right = np.minimum(tile.ids[a], tile.ids[b]), np.maximum(tile.ids[a], tile.ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return _sorted(together, "token", "tile", "share").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids whose sets do link, by intersecting them."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "a", "b")
    texts = docs.join(ends, "doc_id").select("a", "b", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["a", "b"]):
            found = []
            held: tuple[tuple, dict] = (None, None), {}
            for a, b, doc_id, text in pieces_of(batch):
                if held[0] != (a, b):
                    held = (a, b), {}
                (own,) = shingles.sets([text])
                other = b if doc_id == a else a
                for there in held[1].get(other, []):
                    shared = len(np.intersect1d(own, there, assume_unique=True))
                    if linked(shared, len(own), len(there)):
                        found.append((a, b))
                held[1].setdefault(doc_id, []).append(own)
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "doc_id").mapInArrow(run, "a long, b long").distinct()


def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for lists in pieces([batch], 3):
        yield from zip(*lists)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are runs of other characters than space, tab and line ends, A-Z in lower
    case; a set has the distinct five-word shingles, or the whole sequence of fewer
    words. Documents link when their sets share 0.8 of what they have together;
    ``component_id`` is the smallest doc_id reachable by links. A null text, or one
    without words, has no shingle and no link. Rows with one doc_id and different
    texts bring those texts' components together; repeated rows give repeated rows,
    an empty table none; a null doc_id has no links and a null component. Columns
    other than doc_id and text are not read. Shingles are compared by 64-bit hashes.

    Exact: equal sets are one class; of the others, any two that link have a token
    in common among the first fifth of their shingles in one order. Documents with a
    token meet only those of sizes that can link, in tiles where they are many, and
    bitmaps bound what a pair can share before the sets are intersected. A first
    round verifies pairs that would connect a tile or a document; the second all
    others between documents that are still in different components.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = pin(describe(docs), "sets")
    known = described.where("shingle IS NULL").select("doc_id", "n", "d1", "d2", "bits", "wide")
    often = described.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times"))
    often = often.orderBy(F.col("times").desc(), "shingle").limit(FREQUENT).orderBy("times", "shingle").select("shingle")
    frequent = np.array([r[0] for r in often.collect()], np.int64).view(np.uint64)
    total = known.agg(F.sum("n")).first()[0] or 0

    classes = known.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    of = pin(known.join(classes, ["n", "d1", "d2"], "left").select("doc_id", "n", "rep", "bits", "wide"), "classes")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = entries(docs, frequent, max(width, total // 5 // ENTRIES))
    rows = tokens.join(of.select("doc_id", "rep", "n"), "doc_id").select("token", "rep", "n", "often")
    rows = pin(rows, "tokens")
    met = pin(few(rows.where("NOT often").select("token", "rep", "n")), "few")
    many = met.where("token IS NOT NULL").select("token", F.col("a").alias("rep"), "n")
    many = many.union(rows.where("often").select("token", "rep", "n").distinct())
    bits = of.where("doc_id = rep").select("rep", "n", F.col("wide").alias("bits"))

    tried = pin(first_pairs(tiled(many).join(bits, ["rep", "n"])), "first-pairs")
    pairs = pin(likely(met.where("token IS NULL").select("a", "b").distinct(), of), "likely")
    # First what connects: of a document's likely links the one to the smallest id, and what connects tiles.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = pin(first.union(tried.where("a IS NOT NULL").select("a", "b")).distinct(), "first")
    links = pin(verified(first, docs), "links")
    found = pin(components(links), "components")
    of_rep = found.withColumnRenamed("id", "rep")
    open_tokens = tried.where("token IS NOT NULL").select("token").distinct()
    rest = many.join(open_tokens, "token").join(of_rep, "rep", "left")
    rest = rest.withColumn("component", F.coalesce("component", "rep"))
    apart = pairs
    for side in ("a", "b"):
        apart = apart.join(found.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    apart = apart.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    later = other_pairs(rest, bits).union(apart).distinct().join(first, ["a", "b"], "left_anti")
    later = pin(later, "later")
    if later.limit(1).count():
        found = pin(components(links.union(verified(later, docs))), "components")
    members = of.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    # An id with several texts is in several classes, which it brings together.
    twice = of.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    if twice.limit(1).count():
        apart = of.join(twice.select("doc_id"), "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        edges = found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(apart.where("a IS NOT NULL"))
        members = of.join(pin(components(edges), "components").withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return members.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
