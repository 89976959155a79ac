"""Substring dedup: winnowed anchors as seeds, extended both ways, removing long repeats of earlier documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import stored

from . import _filter, _words
from ._arrow import map_slices

WINDOW, GRAM = 50, 20
_SLICE = 1 << 20


def _anchors(words: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """For runs of windows that winnowing gives the same anchor: the anchor's and the context's hash, text, first, last.

    Each window's anchor is the least gram hash in it (the first of equal ones), so equal windows have equal anchors
    in equal places. The context of a run is all words that its windows cover, with the anchor's place in them.
    """
    n = len(words)
    whole = _words.spans(words, window)
    length = np.diff(offsets)
    valid = np.zeros(max(0, n - window + 1), bool)
    for a, size in zip(offsets[:-1].tolist(), length.tolist(), strict=True):
        if size >= window:
            valid[a : a + size - window + 1] = True
    start = np.flatnonzero(valid)
    if not len(start):
        return whole, np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    grams = _words.spans(words, gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = np.concatenate([view[start[i : i + 65536]].argmin(1) for i in range(0, len(start), 65536)]) + start
    text = np.searchsorted(offsets, start, "right") - 1
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))
    lo = start[new]
    hi = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    at = place[new]
    # A run is no longer than a window, so its first and its last window cover all its words.
    context = _words.mix(_words.mix(whole[lo] + (hi - lo).astype(np.uint64)) + whole[hi])
    context = _words.mix(context + (at - lo).astype(np.uint64))
    return whole, grams[at], context, text[new], lo, hi


def _seeds(rows: DataFrame, window: int, gram: int, shared=None) -> DataFrame:
    """Rows (anchor, context, doc, body, lo, hi) of all runs; `shared` (a filter on contexts) leaves out the rest."""

    def work():
        table = shared.value if shared is not None else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, offsets = _words.word_hashes(*_words.buffers(batch.column(2)), fold=False)
            _, anchor, context, text, lo, hi = _anchors(words, offsets, window, gram)
            if table is not None:
                keep = _filter.contains(table, context)
                anchor, context, text, lo, hi = anchor[keep], context[keep], text[keep], lo[keep], hi[keep]
            first = offsets[text]
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array((lo - first).astype(np.int32)), pa.array((hi - first).astype(np.int32))],
                names=["anchor", "context", "doc", "body", "lo", "hi"],
            )

        return step

    return _map(rows, work, "anchor long, context long, doc long, body long, lo int, hi int")


def _map(rows: DataFrame, work, schema: str) -> DataFrame:
    return map_slices(rows, work, schema, most=_SLICE)


_WINDOWS = "window long, doc long, body long, at int"


def _spread(batch: pa.RecordBatch, whole: np.ndarray, offsets: np.ndarray, text: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The windows of runs that begin at the words `lo` of the texts `text` and have `size` windows each."""
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text = np.repeat(text, size)
    return pa.RecordBatch.from_arrays(
        [pa.array(whole[at].view(np.int64)), batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array((at - offsets[text]).astype(np.int32))],
        names=["window", "doc", "body", "at"],
    )


def _windows_of(rows: DataFrame, window: int, gram: int, firsts: DataFrame) -> DataFrame:
    """The same as `_windows`, with the runs of `firsts` (context, first) found by joins: for more than a filter holds."""
    runs = _seeds(rows, window, gram).join(firsts.withColumnRenamed("first", "doc"), ["context", "doc"], "left_semi")
    runs = runs.groupBy("doc", "body").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, offsets = _words.word_hashes(*_words.buffers(batch.column(2)), fold=False)
            held = batch.column(3)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64))
            lo, hi = (held.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            return _spread(batch, _words.spans(words, window), offsets, text, lo + offsets[text], hi - lo + 1)

        return step

    return _map(rows.join(runs, ["doc", "body"]).select("doc", "body", "text", "runs"), work, _WINDOWS)


def _windows(rows: DataFrame, window: int, gram: int, firsts) -> DataFrame:
    """Rows (window hash, doc, body, at) of the windows of those runs whose (context, doc) passes the filter."""

    def work():
        table = firsts.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, offsets = _words.word_hashes(*_words.buffers(batch.column(2)), fold=False)
            whole, _, context, text, lo, hi = _anchors(words, offsets, window, gram)
            docs = batch.column(0).to_numpy()
            keep = _filter.contains(table, _pair(context, docs[text])) if len(text) else np.zeros(0, bool)
            return _spread(batch, whole, offsets, text[keep], lo[keep], (hi - lo + 1)[keep])

        return step

    return _map(rows, work, _WINDOWS)


def _pair(context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return _words.mix(context.view(np.uint64) ^ _words.mix(doc.astype(np.int64).view(np.uint64)))


def _pair_keys(firsts: DataFrame) -> DataFrame:
    """The same as `_pair`, for rows (context, first)."""

    def run(batches):
        for b in batches:
            h = _pair(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return firsts.select("context", "first").mapInArrow(run, "h long")


def _extended(words: list[bytes], others: list[bytes], seeds: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The maximal ranges of `words` that hold a window of a seed and occur in `others`; seeds come sorted.

    Each seed's windows are looked up among the other text's by hash, compared word for word, and extended both ways
    as far as the words agree.
    """
    h, g = (_words.word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]), fold=False)[0] for t in (b" ".join(words), b" ".join(others)))
    mine, theirs = _words.spans(h, window), _words.spans(g, window)
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    out: list[tuple[int, int]] = []
    for start, end in seeds:
        at = start
        while at + window <= end:
            if out and out[-1][0] <= at and at + window <= out[-1][1]:
                at = out[-1][1] - window + 1
                continue
            found = None
            for k in range(int(np.searchsorted(ranked, mine[at])), len(ranked)):
                q = int(order[k])
                if ranked[k] != mine[at]:
                    break
                if words[at : at + window] == others[q : q + window]:
                    found = q
                    break
            if found is None:
                at += 1
                continue
            i, j, left, right = at, found, at + window, found + window
            while i and j and words[i - 1] == others[j - 1]:
                i, j = i - 1, j - 1
            while left < len(words) and right < len(others) and words[left] == others[right]:
                left, right = left + 1, right + 1
            out.append((i, left))
            at = left - window + 1
    return out


def _slices(rows: DataFrame) -> DataFrame:
    """Of rows (doc, body, first, seeds, text) the words from the first seed to the last, and where they start."""

    def run(batches):
        for batch in batches:
            texts, starts = [], []
            for seeds, t in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                start = seeds[0]["start"]
                texts.append(b" ".join(t.as_py().encode().split()[start : max(s["end"] for s in seeds)]).decode())
                starts.append(start)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(starts, pa.int32()), pa.array(texts, pa.string())], names=["doc", "body", "first", "seeds", "begin", "part"])

    return rows.mapInArrow(run, "doc long, body long, first long, seeds array<struct<start:int,end:int>>, begin int, part string")


def _by_pairs(rows: DataFrame, seeds: DataFrame, window: int) -> DataFrame:
    """Rows (doc, body, start, end): the seeds (doc, body, first, start, end), extended in pairs of texts."""
    pairs = stored(seeds.groupBy("doc", "body", "first").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("seeds")))

    def only(key: str) -> DataFrame:
        wanted = pairs.select(F.col(key).alias("doc")).distinct()
        held = _filter.build(wanted, F.xxhash64("doc"))
        if held is None:
            return rows.join(stored(wanted), "doc", "left_semi")

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(_filter.contains(held.value, batch.column(0).to_numpy()))).select([1, 2, 3])

        return rows.select(F.xxhash64("doc"), "doc", "body", "text").mapInArrow(run, "doc long, body long, text string")

    mine = _slices(only("doc").join(pairs, ["doc", "body"]).select("doc", "body", "first", "seeds", "text"))
    both = mine.join(only("first").select(F.col("doc").alias("first"), F.col("text").alias("other")), "first").select("doc", "body", "seeds", "begin", "part", "other")

    def run(batches):
        for batch in batches:
            at, starts, ends = [], [], []
            for k, (seeds_, begin, part, other) in enumerate(zip(*(batch.column(i) for i in range(2, 6)), strict=True)):
                begin = begin.as_py()
                ranges = [(s["start"] - begin, s["end"] - begin) for s in seeds_.as_py()]
                for a, b in _extended(part.as_py().encode().split(), other.as_py().encode().split(), ranges, window):
                    at.append(k)
                    starts.append(a + begin)
                    ends.append(b + begin)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc", "body", "start", "end"])

    return both.mapInArrow(run, "doc long, body long, start int, end int")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal ranges of words (doc, body, spans of start and end) that also occur in a document with a smaller key.

    A range is covered by windows of `window` words whose sequence starts in a smaller document as well; `body`
    (a hash of the text) tells apart rows that share a key.

    Seeds are winnowed grams: documents that share a window share its anchor. Around an anchor stand the words of all
    windows that chose it, its context, and a run whose whole context occurs in a smaller document has the first such
    document as its partner. What is left are the first runs of their context whose anchor occurs with other
    contexts: these alone look for a partner window by window. So each seed has one partner, however many documents
    share it: steps group by hashes with sums made before the shuffle, or join rows to one row by key, and groups of
    copies cost a row each and never meet in pairs. At last each document is joined with its partners, and seeds are
    extended both ways by comparing the words themselves: hashes only propose, and nothing is removed by them.
    """
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")
    )
    contexts = _seeds(rows, window, gram).groupBy("anchor", "context").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    contexts = stored(contexts)
    # Stored, the side with one row a key doesn't keep Spark from splitting a hot key of the other side.
    anchors = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("a"), F.max("last").alias("b"))
    anchors = stored(anchors.filter("n > 1 and a < b").select("anchor"))
    # Of an anchor with several contexts, all first runs are compared, the earliest among them.
    both = contexts.join(anchors, "anchor", "left_semi").select("context", "first")
    again = contexts.filter("first < last").select("context", "first")

    shared = _filter.build(again, F.col("context"))
    whole = (
        _seeds(rows, window, gram, shared)
        .join(again, "context")
        .filter("doc > first")
        .select("doc", "body", "first", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
    )
    firsts = _filter.build(stored(_pair_keys(both)), F.col("h"))
    seen = stored(_windows(rows, window, gram, firsts) if firsts is not None else _windows_of(rows, window, gram, both))
    least = seen.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    part = seen.join(stored(least.select("window", "first")), "window").filter("doc > first").select("doc", "body", "first", F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    return _by_pairs(rows, whole.unionByName(part), window).groupBy("doc", "body").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove every word that `repeats` covers: key, n_words, n_removed, kept_sha256 and, with `keep_text`, kept.

    Kept words are joined by one space. Windows are judged on the input, so the first document with a passage
    keeps it; within one document repeats stay. A null text has no words, a null key is compared with nothing, rows
    that share a key are not compared with each other, keys are integers, other columns are not read, and an empty table gives an
    empty result. Texts are whole, and no number of copies is too many.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    found = repeats(docs, window, gram, key, text)
    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    rows = rows.join(found, ["doc", "body"], "left").select("key", "text", "spans")

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, removed, kept = [], [], []
            for t, spans in zip(pc.fill_null(batch.column(1), "").to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = t.encode().split()  # bytes part at just these six characters
                total.append(len(words))
                if spans:
                    left, at = [], 0
                    for s in spans:
                        if s["start"] > at:
                            left += words[at : s["start"]]
                        at = max(at, s["end"])
                    words = left + words[at:]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["key", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([k.decode() for k in kept], pa.string()))
                names.append("kept")
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    schema = f"key {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return map_slices(rows, work, schema).withColumnRenamed("key", key)
