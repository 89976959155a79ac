"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is the set of its distinct shingles; equal sets are one class (by a 128-bit fingerprint). Shingles have
one order for all documents, rare ones first by exact counts. If two sets are similar enough, their prefixes that
leave out `least overlap - l` shingles share l shingles at least. Each set takes the l that costs least by the
counts: longer prefixes need more shared shingles before a pair is verified, and a pair needs the smaller l of its
two.

The counts are exact and not broadcast. Each scan task cuts its documents into chunks and sends a chunk's distinct
shingles, with the number of its documents that have each, to the buckets that count them; a bucket sends back to each
chunk only those that several documents have, with their counts. Which documents of a chunk have a shingle stays with the
chunk's own row, but for shingles of a single one. So a shingle is one entry a chunk, however common it is. Chunks and
buckets grow alike, with the square root of the input, up to MOST_WIDTH.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored

from . import _filter, _words
from ._arrow import map_slices, slices
from .components import components, with_names

#: Bytes of text that a chunk and a bucket stand for: by the square root of the input, between these. The upper one, which
#: bounds a task's memory, is reached at 16 TB; at 100 TB a (chunk, bucket) row still has some hundred shingles.
LEAST_WIDTH, MOST_WIDTH, WIDTH_SCALE = 2 << 20, 256 << 20, 4096
#: Documents of a chunk at most; their numbers have 16 bits.
CHUNK_DOCUMENTS = 1 << 16
#: Prefixes ask for 1 to this many shared shingles; verifying a pair costs about as much as so many list entries.
MOST_MATCHES, VERIFY_COST = 8, 8.0
#: A pair that meets in several lists is taken from one where none of the so many tokens before is common to both.
BEFORE = 16
_SLICE = 1 << 20
_BITS = ["p0", "p1", "p2", "p3"]


def least_overlap(n, threshold: tuple[int, int]):
    """Shingles that a set of n shares at least with any set that is similar enough."""
    part, whole = threshold
    return -(-part * n // whole)


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    words, offsets = _words.word_hashes(*_words.buffers(batch.column("text")), fold=True)
    return _words.shingle_sets(words, offsets, size)


def _fingerprints(sets: list[np.ndarray]) -> pa.Array:
    """128 bits for each set, null for an empty one: two sums of its shingles, mixed in two ways."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        flat, first = np.concatenate(sets), (np.cumsum(n) - n)[full]
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)):
            sums = np.add.reduceat(_words.mix(_words.mix(flat ^ np.uint64(salt))), first)
            out[full, k] = _words.mix(sums + n[full].astype(np.uint64) * np.uint64(salt))
    held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sets), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
    return pc.if_else(pa.array(n > 0), held, pa.nulls(len(sets), pa.binary()))


def _chunk(number: int, buckets: int, docs: pa.Array, sets: list[np.ndarray]):
    """The rows of a chunk: its shingles by bucket, and one row that describes its documents."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    ids = (flat >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)
    order = np.argsort(ids, kind="stable")
    ids, idx = ids[order], np.repeat(np.arange(len(sets), dtype=np.uint16), n)[order]
    # Shingles of one document that fall on the same id count once; prefixes allow for it.
    keep = np.append(True, (ids[1:] != ids[:-1]) | (idx[1:] != idx[:-1]))[: len(ids)]
    ids, idx = ids[keep], idx[keep]
    distinct = np.bincount(idx, minlength=len(sets))
    maps = list(map(_parity, sets))
    short = np.array([_folded(m, 32).view(np.int64) for m in maps]).reshape(len(sets), len(_BITS)).T
    head = pa.RecordBatch.from_arrays(
        [docs, pa.array(n.astype(np.int32)), pa.array(distinct.astype(np.int32)), _fingerprints(sets), pa.array([m.tobytes() for m in maps], pa.binary()), *map(pa.array, short)],
        names=["doc", "n", "distinct", "node", "bits", *_BITS],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as writer:
        writer.write_batch(head)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    m = np.diff(np.append(first, len(ids))).astype(np.uint32)
    several = np.repeat(m > 1, m)
    lists, ids, one = idx[several], ids[first], m == 1
    rows = []
    bucket = (ids >> np.uint64(32)).astype(np.int32)
    cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]).tolist(), len(ids)]
    low, held = (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32), idx[first]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own = one[x:y]
        rows.append((int(bucket[x]), low[x:y][own].tobytes(), held[x:y][own].tobytes(), low[x:y][~own].tobytes(), m[x:y][~own].tobytes(), None))
    # The chunk's own row, in a group of its own: its documents, and those that share a shingle within the chunk.
    place = int(_words.mix(np.array([number], np.uint64))[0] >> np.uint64(34))
    rows.append((-1 - place, ids[~one].tobytes(), lists.tobytes(), None, m[~one].tobytes(), sink.getvalue().to_pybytes()))
    kinds = (pa.int32(), *[pa.binary()] * 5)
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([columns[0], pa.array([number] * len(rows), pa.int64()), *columns[1:]], names=_SENT)


_SENT = ["bucket", "chunk", "low", "idx", "shared", "m", "head"]


def _numbers(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def _count(key, table):
    """In a bucket: what each chunk has of the shingles that several documents have, with the counts.

    `low` and `idx` are shingles of one document of a chunk, `n` their counts; `shared` are those of several, `m` theirs.
    """
    names = ["chunk", "bucket", "low", "idx", "n", "shared", "m", "head"]
    if key[0].as_py() < 0:
        none = pa.nulls(table.num_rows, pa.binary())
        return pa.table([table["chunk"], table["bucket"], table["low"], table["idx"], none, none, table["m"], table["head"]], names=names)
    low, idx, shared, m = (_numbers(table[c], k) for c, k in (("low", np.uint32), ("idx", np.uint16), ("shared", np.uint32), ("m", np.uint32)))
    flat = np.concatenate([x for pair in zip(low, shared, strict=True) for x in pair])
    documents = np.concatenate([x for a, b in zip(low, m, strict=True) for x in (np.ones(len(a), np.uint32), b)])
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0)[: len(flat)])
    n = np.empty(len(flat), np.uint32)
    if len(flat):
        n[order] = np.repeat(np.add.reduceat(documents[order], first, dtype=np.uint64).clip(max=2**32 - 1).astype(np.uint32), np.diff(np.append(first, len(flat))))
    rows, at = [], 0
    for chunk, x, i, y in zip(table["chunk"].to_pylist(), low, idx, shared, strict=True):
        c, d = n[at : at + len(x)], n[at + len(x) : at + len(x) + len(y)]
        at += len(x) + len(y)
        more = c > 1
        if more.any() or len(y):
            rows.append((chunk, key[0].as_py(), x[more].tobytes(), i[more].tobytes(), c[more].tobytes(), y.tobytes(), d.tobytes(), None))
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6)
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


def choose_prefix(counts: np.ndarray, n: int, distinct: int, threshold: tuple[int, int]) -> tuple[int, int]:
    """How many shared shingles of a set belong to its prefix, and the number of matches that it asks for.

    `counts` are those of the set's shared shingles, in order; its other distinct ids are rare and come before.
    """
    rare, first = distinct - len(counts), n - least_overlap(n, threshold)
    matches = np.arange(1, min(MOST_MATCHES, n - first) + 1)
    taken = np.clip(first + matches - rare, 0, len(counts))
    cost = np.append(0, np.cumsum(counts - 1.0))[taken] * (1 + VERIFY_COST / matches)
    best = int(np.argmin(cost))
    return int(taken[best]), int(matches[best])


def _prefixes(threshold: tuple[int, int]):
    def work(key, table):
        """In a chunk: a row for each document, with the shared shingles of its prefix."""
        described = pc.is_valid(table["head"])
        own = table.filter(described)
        head = pa.ipc.open_stream(own["head"][0].as_buffer()).read_all()
        parts = table.filter(pc.invert(described))
        size, distinct = head["n"].to_numpy(), head["distinct"].to_numpy()
        pri, tokens = np.minimum(distinct, 1 << 24).astype(np.int64) * MOST_MATCHES, [[]] * len(size)
        if parts.num_rows:
            low, idx, n = (_numbers(parts[c], k) for c, k in (("low", np.uint32), ("idx", np.uint16), ("n", np.uint32)))
            high = parts["bucket"].to_numpy().astype(np.uint64) << np.uint64(32)
            ids, idx, n = np.repeat(high, list(map(len, low))) | np.concatenate(low), np.concatenate(idx), np.concatenate(n)
            # Shingles of several documents here all come back; their documents are in the chunk's own row.
            shared, total = (_numbers(parts[c], np.uint32) for c in ("shared", "m"))
            several = np.repeat(high, list(map(len, shared))) | np.concatenate(shared)
            by, m = np.argsort(several), np.frombuffer(own["m"][0].as_buffer(), np.uint32)
            ids = np.concatenate([ids, np.repeat(several[by], m)])
            idx = np.concatenate([idx, np.frombuffer(own["idx"][0].as_buffer(), np.uint16)])
            n = np.concatenate([n, np.repeat(np.concatenate(total)[by], m)])
            order = np.lexsort((ids, n, idx))
            ids, idx, n = ids[order].view(np.int64), idx[order], n[order]
            first = np.flatnonzero(np.append(True, np.diff(idx.astype(np.int32)) != 0))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(idx)], strict=True):
                d = int(idx[a])
                taken, matches = choose_prefix(n[a:b], int(size[d]), int(distinct[d]), threshold)
                pri[d] = min(int(distinct[d]) - (b - a), 1 << 24) * MOST_MATCHES + matches - 1
                tokens[d] = ids[a : a + taken]
        return pa.table([*(head[c] for c in ("doc", "n", "node", "bits", *_BITS)), pa.array(pri.astype(np.int32)), pa.array(tokens, pa.list_(pa.int64()))], names=["doc", "n", "node", "bits", *_BITS, "pri", "tokens"])

    return work


def _front(rows: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """One row a document: doc, n, node, bits and a short bitmap, pri, and the shared tokens of its prefix; stored."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = int(min(max((total * WIDTH_SCALE) ** 0.5, LEAST_WIDTH), MOST_WIDTH))
    buckets = max(1, -(-total // width))

    def run(batches):
        from pyspark import TaskContext

        number, docs, sets, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                if sets and (held + part.nbytes > width or len(sets) + part.num_rows > CHUNK_DOCUMENTS):
                    yield _chunk(number, buckets, pa.concat_arrays(docs), sets)
                    number, docs, sets, held = number + 1, [], [], 0
                docs.append(part.column("doc"))
                sets += _sets(part, size)
                held += part.nbytes
        if sets:
            yield _chunk(number, buckets, pa.concat_arrays(docs), sets)

    kind = rows.schema["doc"].dataType.simpleString()
    sent = rows.mapInArrow(run, "bucket int, chunk long, low binary, idx binary, shared binary, m binary, head binary")
    counted = sent.groupBy("bucket").applyInArrow(_count, "chunk long, bucket int, low binary, idx binary, n binary, shared binary, m binary, head binary")
    short = "".join(f", {b} long" for b in _BITS)
    return stored(counted.groupBy("chunk").applyInArrow(_prefixes(threshold), f"doc {kind}, n int, node binary, bits binary{short}, pri int, tokens array<long>"))


def _parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of about a bit a shingle (256 at least), each the parity of the shingles that fall on it.

    Two sets differ in at least as many shingles as their bitmaps do in bits.
    """
    size = 1 << max(8, (len(s) - 1).bit_length())
    at = (_words.mix(s) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set in `size` bytes."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _shingle_rows(rows: DataFrame, size: int, wanted) -> DataFrame:
    """Rows (node, shingles) of the documents that the filter `wanted` lets through (all without one), each set once a task."""

    def work():
        table, seen = wanted.value if wanted is not None else None, set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if table is not None:
                batch = batch.filter(pa.array(_filter.contains(table, batch.column("h").to_numpy())))
            nodes, packed = [], []
            if batch.num_rows:
                if len(seen) > 100_000:
                    seen.clear()
                sets = _sets(batch, size)
                for s, node in zip(sets, _fingerprints(sets).to_pylist(), strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        packed.append(s.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())], names=["node", "shingles"])

        return step

    return map_slices(rows.select(F.xxhash64("doc").alias("h"), "text"), work, "node binary, shingles binary", most=_SLICE)


def _near(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of `pairs` (a, b) that their bitmaps don't rule out; a bitmap has an eighth of a byte a shingle."""
    part, whole = threshold
    held = classes.select("node", "n", "bits")
    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
    joined = joined.join(held.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
                keep.append(differ * (part + whole) <= (na.as_py() + nb.as_py()) * (whole - part))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a binary, b binary")


def _meeting(every: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of `every`'s classes of different components that meet in a list and may be similar by a short bitmap.

    `every` has the entries (token, node, n, the short bitmap, comp) of lists with more than one component, and `main`, the
    component of a list's leader. Near copies meet in many lists, since their prefixes are nearly the same. Each entry has its
    class's BEFORE tokens before it, in order; where two entries have one of these in common, the pair has met in
    that list. A pair's first list always gives it, a later one only after BEFORE tokens that the other set lacks.
    """
    part, whole = threshold
    before = Window.partitionBy("node").orderBy("token").rowsBetween(-BEFORE, -1)
    every = stored(every.withColumn("before", F.collect_list("token").over(before)))
    a, b = every.filter("comp <> main").alias("a"), every.alias("b")
    differ = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in _BITS[1:]), F.bit_count(F.col("a.p0").bitwiseXOR(F.col("b.p0"))))
    both = F.col("a.n") + F.col("b.n")
    near = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.comp") != F.col("b.comp"))
        & ((F.col("b.comp") == F.col("a.main")) | (F.col("a.node") < F.col("b.node")))
        & (F.col("a.n") * whole >= F.col("b.n") * part)
        & (F.col("b.n") * whole >= F.col("a.n") * part)
        & (differ * (part + whole) <= both * (whole - part))
        & ~F.arrays_overlap("a.before", "b.before")
    )
    return a.join(b, near).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def _sharing(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) that share as many tokens of their prefixes as the smaller of their numbers of matches asks for."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held = entries.join(ends, "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("tokens"), (F.first("pri") % MOST_MATCHES + 1).alias("m"))
    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("tokens").alias("x"), F.col("m").alias("ma")), "a")
    joined = joined.join(held.select(F.col("node").alias("b"), F.col("tokens").alias("y"), F.col("m").alias("mb")), "b")
    return joined.filter(F.size(F.array_intersect("x", "y")) >= F.least("ma", "mb")).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, threshold: tuple[int, int], entries: DataFrame | None = None) -> DataFrame:
    """Those of `pairs` (a, b) whose whole sets are similar enough. With `entries`, those that share too few of them go before."""
    part, whole = threshold
    pairs = stored(_near(pairs, classes, threshold))
    if entries is not None:
        pairs = stored(_sharing(pairs, entries))
    named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stored(classes.join(named, "node", "left_semi").select("rep"))
    wanted = _filter.build(needed, F.xxhash64("rep"))
    sets = _shingle_rows(rows if wanted is not None else rows.join(needed.withColumnRenamed("rep", "doc"), "doc", "left_semi"), size, wanted)
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(whole * common >= part * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stored(joined.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary").distinct())


def join_documents(
    docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text", all_links: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The similarity join of `docs` with itself: (membership, links).

    A-Z are lower-cased; words part at the bytes 0x20 and 0x09 to 0x0D; a document's set has its distinct shingles
    of `size` words, or its whole sequence if it has fewer. Sets link when whole * |x & y| >= part * |x | y|.

    membership: doc, n (size of the set) and node (its class: equal sets share one, empty ones have null). links:
    pairs (a, b) of linked classes; with `all_links` every one, otherwise enough to connect all that are connected:
    pairs already in one component are not verified again. Texts that are null or have no words have n = 0 and no
    link. Keys may be of any type that can be ordered, null (then without links) or repeated: each row is a
    document. Other columns are not read, and empty tables give empty results. `docs` is read several times, in the
    same partitions, as tables give them. Texts travel in Arrow batches, whose bytes the session bounds.

    Where many sets meet in a list, each is first compared with one leader, the set of a list with the fewest rare
    shingles: a pair a set. Only sets that this leaves in different components are then paired, so a large group of
    near copies isn't enumerated.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    front = _front(rows, size, threshold)
    members = front.select("doc", "n", "node")
    usable = front.filter("node is not null and doc is not null")
    # Any document stands for its class.
    classes = stored(usable.select("node", F.col("doc").alias("rep"), "n", "bits", *_BITS).dropDuplicates(["node"]))
    named = rows.filter("text is not null and doc is not null")
    entries = usable.select(F.explode("tokens").alias("token"), "node", "pri", "n").dropDuplicates(["token", "node"])
    entries = stored(entries.withColumn("n", F.col("n").cast("int")))

    lists = entries.groupBy("token").agg(F.min(F.struct("pri", "node")).alias("lead"), F.count("*").alias("k"))
    lists = stored(lists.filter("k > 1").select("token", F.col("lead.node").alias("lead")))

    asked = links = docs.sparkSession.createDataFrame([], "a binary, b binary")
    if not all_links:
        led = entries.select("token", "node").join(lists, "token").filter("node <> lead").groupBy("node", "lead").count()
        best = led.groupBy("node").agg(F.max(F.struct("count", "lead")).alias("m")).select("node", F.col("m.lead").alias("lead"))
        asked = stored(best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
        links = _verified(asked, classes, named, size, threshold)
    comps = components(links)
    grouped = stored(classes.select("node", *_BITS).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mains = lists.join(grouped.select(F.col("node").alias("lead"), F.col("comp").alias("main")), "lead").select("token", "main")
    # Those outside the leader's component in a list and, in lists that have such, all.
    marked = entries.join(stored(mains), "token").join(grouped, "node")
    odd = marked.filter("comp <> main").select("token").distinct()
    pairs = _meeting(marked.join(stored(odd), "token", "left_semi"), threshold).distinct()
    more = _verified(stored(pairs.join(asked, ["a", "b"], "left_anti")), classes, named, size, threshold, entries)
    return members, links.unionByName(more)


def near_duplicates(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles and component_id, the smallest key that links reach (itself without any).

    See `join_documents` for sets, links, and odd rows. A null key has a null component.
    """
    members, links = join_documents(docs, size, threshold, key, text)
    linked = members.filter("node is not null and doc is not null")
    classes = linked.groupBy("node").agg(F.min("doc").alias("first"), F.count("*").alias("k"))
    classes = stored(classes.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    groups = stored(classes.groupBy("comp").agg(F.min("first").alias("least"), F.count("*").alias("c")))
    total = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("k"), F.lit(0)).alias("rows")).first()
    named = stored(with_names(classes, groups, "comp", "c", total["classes"]).select("node", "k", "least"))
    alone = members.filter("node is null or doc is null").select("doc", "n", F.col("doc").alias("least"))
    out = with_names(linked, named, "node", "k", total["rows"]).select("doc", "n", "least").unionByName(alone)
    return out.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))
