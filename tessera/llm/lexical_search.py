"""Ranked lexical search: document FP-trees, searched depth first under bounds.

One scan restricts every document to the terms that some query has: its number of terms and those terms with their
frequencies, a small table that is stored. Terms are then ordered by the documents that hold them, frequent ones first. For
each item, a task puts the vectors of its documents, restricted to the item's terms, into a tree: vectors that begin with
the same terms share a path (an edge takes up to eight terms, and paths without branches are one edge). A node knows the
largest frequency of each term and the smallest m below it, so what its documents can score at most is known; the search
goes depth first to the best child and leaves out nodes that can't reach the item's k-th score so far. Scores are sums of
integers, so the result doesn't depend on how documents are dealt out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored

from ._arrow import map_slices, taken
from .decontaminate import _TABLE

#: Items are searched in blocks of at most this many bytes of text (four for each character); an item is never cut.
BLOCK_BYTES = 4 << 20
#: Documents, and cells (documents by terms of an item), of a tree at most.
TREE_DOCUMENTS, TREE_CELLS = 1 << 14, 1 << 22
#: Nodes of so few documents are scored whole.
LEAF = 24
#: Tasks whose best documents meet first, before the best of all such groups do.
TASKS = 256
#: Long texts are split into terms in pieces of about so many bytes.
_PIECE = 1 << 20


def count_terms(text: str | None, known: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of a text's terms, and how often it has each of the known ones."""
    data = (text or "").encode().translate(_TABLE)
    n, counts, at = 0, Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        words = data[at : end if end >= 0 else len(data)].split()
        at = end if end >= 0 else len(data)
        n += len(words)
        counts.update(map(known.get, words))
    counts.pop(None, None)
    return n, counts


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


@dataclass
class Items:
    """A block of items: their ids, and of each the numbers of its distinct terms."""

    ids: pa.Array
    terms: list[np.ndarray]
    known: dict[bytes, int]


def _blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[Items]:
    kind = items.select(item).limit(0).toArrow().schema.field(0).type
    held, size = [], 0
    for r in items.select(F.col(item).alias("i"), F.col(text).alias("t")).distinct().toLocalIterator():
        n = 4 * len(r["t"] or "")
        if held and size + n > most:
            yield _block(held, kind)
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield _block(held, kind)


def _block(rows: list[tuple], kind: pa.DataType) -> Items:
    words = [set((t or "").encode().translate(_TABLE).split()) for _, t in rows]
    known = {w: k for k, w in enumerate(sorted(set().union(*words)))}
    return Items(pa.array([i for i, _ in rows], kind), [np.array(sorted(map(known.__getitem__, w)), np.int64) for w in words], known)


def _vectors(docs: DataFrame, block: Items, key: str, text: str) -> DataFrame:
    """Rows (key, n, terms, tfs) of all documents with a term, stored."""
    rows, kind, _, _ = taken(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(block.known)

    def work():
        known = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, cuts, terms, tfs = [], [0], [], []
            for t in batch.column(1).to_pylist():
                n, counts = count_terms(t, known)
                sizes.append(n)
                terms += counts.keys()
                tfs += counts.values()
                cuts.append(len(terms))
            cuts = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, k)) for x, k in ((terms, pa.int32()), (tfs, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["key", "n", "terms", "tfs"])
            return out.filter(pc.greater(out["n"], 0))

        return step

    return stored(map_slices(rows, work, f"key {kind}, n long, terms array<int>, tfs array<long>"))


class Tree:
    """The FP-tree of vectors `tf` (documents by terms, frequent terms first) with lengths `m`.

    `order` has the documents in the tree's order; each level is (start of each node, its largest frequencies, its smallest
    m), the first one being the root alone. Nodes of a level split into those of the next.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        bits = np.packbits(tf > 0, axis=1)
        pad = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
        pad[:, : bits.shape[1]] = bits
        words = pad.view(">u8")
        self.order = np.lexsort(words.T[::-1])[::-1]
        self.tf, self.m = tf[self.order], m[self.order]
        bits = bits[self.order]
        differ = bits[1:] != bits[:-1]
        first = np.where(differ.any(1), differ.argmax(1), bits.shape[1])  # the edge where neighbours part
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.append(True, first < bits.shape[1]))
        most, least = np.maximum.reduceat(self.tf, starts), np.minimum.reduceat(self.m, starts)
        for depth in reversed(range(bits.shape[1] + 1)):
            above = np.flatnonzero(np.append(True, first < depth))
            if len(above) < len(starts):
                self.levels.append((starts, most, least))
                at = np.searchsorted(starts, above)
                starts, most, least = above, np.maximum.reduceat(most, at), np.minimum.reduceat(least, at)
        self.levels.append((starts, most, least))
        self.levels.reverse()
        self.ends = [np.append(level[0][1:], len(self.m)) for level in self.levels]


def scores(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What vectors score; of largest frequencies and smallest m, a bound."""
    tf = tf.astype(np.int64)
    return (weights * (1_000_000_000 * tf // (1000 * tf + 20 * m[:, None]))).sum(1)


def best_first(tree: Tree, weights: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the tree of all documents that may be among the k best, their scores, and the k best scores now.

    `top` are the best scores so far, k at most. Documents that equal the k-th are kept, so that ties are told outside.
    """
    places, found, last = [], [], len(tree.levels) - 1
    least = int(top.min()) if len(top) == k else 1  # scores of 0 don't count
    stack = [(0, 0, np.iinfo(np.int64).max)]
    while stack:
        level, node, bound = stack.pop()
        if bound < least:
            continue
        a, b = int(tree.levels[level][0][node]), int(tree.ends[level][node])
        if level == last or b - a <= LEAF:
            s = scores(tree.tf[a:b], tree.m[a:b], weights)
            good = np.flatnonzero(s >= least)
            if len(good):
                places.append(a + good)
                found.append(s[good])
                top = np.concatenate([top, s[good]])
                if len(top) >= k:
                    top = np.partition(top, len(top) - k)[-k:]
                    least = max(1, int(top.min()))
            continue
        starts, most, smallest = tree.levels[level + 1]
        i, j = np.searchsorted(starts, (a, b))
        if j - i == 1:
            stack.append((level + 1, int(i), bound))
            continue
        bounds = scores(most[i:j], smallest[i:j], weights)
        order = np.argsort(bounds)  # the best child is taken first
        order = order[bounds[order] >= least]
        stack += [(level + 1, int(i + c), int(bounds[c])) for c in order]
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(found), top) if places else (none, none, top)


class _Best:
    """The k best documents of each item in a task."""

    def __init__(self, items: Items, position: np.ndarray, weights: np.ndarray, k: int):
        self.k, self.position = k, position
        self.terms = [np.sort(position[t]) for t in items.terms]  # by frequency
        by_place = np.empty(len(position), np.int64)
        by_place[position] = weights
        self.weights = by_place
        self.top = [np.zeros(0, np.int64) for _ in items.terms]
        self.held: list[list] = [[] for _ in items.terms]  # (score, key)

    def add(self, keys: pa.Array, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Search a tree of each item over these documents; `sizes` are numbers of terms."""
        order = pc.array_sort_indices(keys, null_placement="at_start").to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        keys, m, doc = keys.take(pa.array(order)), m[order], np.repeat(number, sizes)
        by = np.lexsort((doc, self.position[terms]))
        place, doc, tfs = self.position[terms][by], doc[by], tfs[by]
        # Of each term its documents, in the order of their keys.
        bounds = np.searchsorted(place, np.arange(len(self.position) + 1))
        for i, wanted in enumerate(self.terms):
            wanted = wanted[(bounds[wanted + 1] > bounds[wanted]) & (self.weights[wanted] > 0)]
            if not len(wanted):
                continue
            at = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in wanted])
            column = np.repeat(np.arange(len(wanted)), bounds[wanted + 1] - bounds[wanted])
            there, row = np.unique(doc[at], return_inverse=True)
            most = max(1, TREE_CELLS // len(wanted))
            for a in range(0, len(there), most):
                part = slice(None) if len(there) <= most else (row >= a) & (row < a + most)
                ids = there[a : a + most]
                tf = np.zeros((len(ids), len(wanted)), np.int32)
                tf[row[part] - a, column[part]] = tfs[at[part]]
                self._search(i, tf, m[ids], ids, self.weights[wanted], keys)

    def _search(self, i: int, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, weights: np.ndarray, keys: pa.Array) -> None:
        tree = Tree(tf, m)
        places, found, self.top[i] = best_first(tree, weights, self.top[i], self.k)
        if not len(places):
            return
        ids = ids[tree.order[places]]
        cut = np.lexsort((ids, -found))[: self.k]  # ids are in the order of keys
        new = list(zip(found[cut].tolist(), keys.take(pa.array(ids[cut])).to_pylist(), strict=True))
        self.held[i] = sorted(self.held[i] + new, key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))[: self.k]


def _best(vectors: DataFrame, block: Items, first: int, df: np.ndarray, n_documents: int, n_terms: int, k: int, item_kind: str, key_kind: str) -> DataFrame:
    """Rows (number, item, key, score, part): of each task the k best documents of each item; items are numbered from `first`."""
    position = np.empty(len(df), np.int64)
    position[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weights = np.array([weight(n_documents, int(d)) for d in df], np.int64)
    terms = Items(block.ids, block.terms, {})
    sent = vectors.sparkSession.sparkContext.broadcast((terms, position, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, position, weights = sent.value
        best, held, rows = _Best(items, position, weights, k), [], 0

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            n, terms = table["n"].to_numpy(), table["terms"].combine_chunks()
            m = 100 - 50 + 50 * n * n_documents // n_terms
            keys = table["key"].combine_chunks()
            best.add(keys, m, pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64), terms.flatten().to_numpy(), table["tfs"].combine_chunks().flatten().to_numpy())

        for batch in batches:
            for a in range(0, batch.num_rows, TREE_DOCUMENTS):
                part = batch.slice(a, TREE_DOCUMENTS)
                if rows + part.num_rows > TREE_DOCUMENTS:
                    search()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            search()
        part = TaskContext.get().partitionId() // TASKS
        for i, found in enumerate(best.held):
            if found:
                same = pa.array([i] * len(found))
                columns = [pa.array([first + i] * len(found)), items.ids.take(same), pa.array([x for _, x in found], key_type)]
                columns += [pa.array([s for s, _ in found], pa.int64()), pa.array([part] * len(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "item", "key", "score", "part"])

    key_type = vectors.select("key").limit(0).toArrow().schema.field(0).type
    return vectors.mapInArrow(run, f"number long, item {item_kind}, key {key_kind}, score long, part int")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Of each item its k best documents with a score above 0: item, rank (from 1), key and score.

    Terms are runs of letters A-Z (taken as a-z), digits and non-ASCII characters. With N documents that have a term, L
    terms in all, df documents with a term and n terms in a document, w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    m = 50 + (50 * n * N) div L; a document scores the sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the
    item's distinct terms. Equal scores are in the order of keys, null first.

    The items are a stated query set; they are taken in blocks of bounded size, each of which scans all documents. What
    comes to the driver is a block's items and the numbers of documents of their terms. Null texts have no terms; equal
    items count once, and of different texts under one id each has its own ranking. Rows of `docs` are documents, each on
    its own, whatever their keys; other columns are not read, and empty tables give empty results. Keys are of a type that
    can be ordered.
    """
    out, totals, first = None, None, 0
    kinds = items.select(F.col(item).alias("item")).schema["item"].dataType.simpleString(), docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    for block in _blocks(items, item, item_text, block_bytes):
        vectors = _vectors(docs, block, key, text)
        totals = totals or vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df = np.zeros(len(block.known), np.int64)
        df[counted["term"].to_numpy()] = counted["count"].to_numpy()
        found = _best(vectors, block, first, df, int(totals[0]), int(totals[1]), k, *kinds)
        out, first = found if out is None else out.unionByName(found), first + len(block.ids)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"number long, item {kinds[0]}, key {kinds[1]}, score long, part int")
    by = [F.col("score").desc(), F.col("key").asc_nulls_first()]
    near = out.withColumn("rank", F.row_number().over(Window.partitionBy("number", "part").orderBy(*by))).filter(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*by))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
