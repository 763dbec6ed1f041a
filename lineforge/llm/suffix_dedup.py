"""Suffix-array dedup: bytes that repeat an earlier document's, by interval expansion on a Burrows-Wheeler order.

Bytes covered by a string of ``LENGTH`` bytes that also starts in a document
with a smaller doc_id are removed.  Every string of that length is assigned
to the least of its ``GRAM``-byte hashes (its anchor), so equal strings have
equal anchors wherever they stand:

1. Texts that equal an earlier one are done.
2. Anchors are aggregated; those of one document alone are done.
3. For each other anchor, the stretch of text whose strings it stands for is
   a context.  Equal contexts are one, held by its least document; a later
   holder loses all of its strings.
4. Contexts that differ but share an anchor are gathered in bounded batches.
   In each, suffixes are kept in the order of a Burrows-Wheeler transform:
   starting from the intervals of suffixes with equal first bytes, all
   intervals of a level are extended backwards at once (a block of bytes a
   step, so common prefixes come by increasing length), breadth first,
   intervals of one suffix are dropped, and expansion stops at ``LENGTH``.
   The intervals left are the equal strings; each goes to its least document.
   An anchor with very many contexts has its strings grouped by Spark
   instead, which spreads them over all tasks, with the same result.

A null text is empty; texts shorter than ``LENGTH`` lose nothing; matches
never cross documents.  Rows with equal doc_id are one document and do not
remove each other's text; a null doc_id has no place in the order, so its row
neither loses bytes nor takes them from others.  Long and repetitive texts are
treated whole.  Of equal strings in several documents the one with the
smallest doc_id keeps them, so ties do not arise.  An empty table gives no
rows.  Extra columns never reach the worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, map_rows, no_nulls, pieces, released, small, to_arrow, written

LENGTH, GRAM = 50, 20
#: A context has at most so many strings (longer runs of one anchor, as in repetitive text, are cut).
RUN = 64
#: Bytes of contexts expanded at a time in a worker; contexts of one anchor beyond which Spark groups its strings.
BATCH_BYTES, MANY = 1 << 20, 20_000
#: Contexts to a task of the expansion.
TASK_CONTEXTS = 100_000
#: Narrow keys are broadcast up to so many rows.
BROADCAST_KEYS = 1_000_000
#: Bits of the anchor filter (a power of two, 16 MB), and anchors that it can tell from others well.
FILTER_BITS, FILTER_ANCHORS = 1 << 27, 1 << 24
PACK = 1 << 31
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes, by doubling."""
    with np.errstate(over="ignore"):
        h, width, power = TABLE[raw], 1, BASE
        out, done, bits = None, 0, gram
        while bits:
            if bits & 1:  # append the piece of this width to what has been covered so far
                if out is None:
                    out = h.copy()
                else:
                    n = min(len(out), len(h) - done)
                    out = out[:n] * power + h[done:done + n]
                done += width
            bits >>= 1
            if bits:
                h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
                width, power = 2 * width, power * power
        out = out[: max(0, len(raw) - gram + 1)]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string and number of strings of each context of a text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    low = gram_hashes(np.frombuffer(data, np.uint8), gram)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width:])
    edge = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
    size = np.diff(edge)
    if size.max() > RUN:
        edge = np.concatenate([np.arange(a, b, RUN) for a, b in zip(edge[:-1], edge[1:])] + [[len(low)]])
        size = np.diff(edge)
    return low[edge[:-1]].astype(np.int64), edge[:-1].astype(np.int64), size.astype(np.int64)


def equal_strings(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval, context and offset of every string of ``length`` bytes that occurs twice or more in ``contexts``."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(contexts)), sizes)
    room = np.repeat(first + sizes, sizes) - np.arange(len(raw))  # bytes to the context's end
    # level by level: the suffixes whose string of `have` bytes lies in an interval of two or more
    step = 5 if length % 5 == 0 else 1
    block = np.zeros(len(raw), np.int64)  # the block of bytes that starts at each place
    for k in range(step):
        block[: len(raw) - k] |= raw[k:].astype(np.int64) << np.int64(8 * (step - 1 - k))
    at = np.flatnonzero(room >= step)
    _, interval = np.unique(block[at], return_inverse=True)
    block[at] = interval  # blocks by their rank: the first level's intervals, in order
    have = step
    at, interval = several(at, interval)
    while have < length and len(at):
        ok = (at - step >= first[owner[at]])
        back = at[ok] - step
        pair = block[back] * np.int64(len(raw)) + interval[ok]  # by the block before, then by the interval: the order of the transform
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        interval, at, have = np.cumsum(np.concatenate([[0], pair[1:] != pair[:-1]])) if len(pair) else pair, back[order], have + step
        at, interval = several(at, interval)
    return interval, owner[at], at - first[owner[at]]


def several(at: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in intervals of two or more."""
    keep = np.bincount(interval)[interval] > 1 if len(interval) else np.zeros(0, bool)
    return at[keep], interval[keep]


def improved(contexts: list[bytes], holders: np.ndarray, length: int = LENGTH) -> dict[int, list[int]]:
    """By context, the runs (first, number) of strings that a smaller holder has too, packed by ``pack``."""
    interval, context, offset = equal_strings(contexts, length)
    if not len(interval):
        return {}
    least = np.full(interval.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, interval, holders[context])
    hit = least[interval] < holders[context]
    c, o = context[hit], offset[hit]
    order = np.lexsort((o, c))
    c, o = c[order], o[order]
    start = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1] + 1)])) if len(c) else c
    count = np.diff(np.concatenate([start, [len(c)]])) if len(c) else c
    out: dict[int, list[int]] = {}
    for k, first, n in zip(c[start].tolist(), o[start].tolist(), count.tolist()):
        out.setdefault(k, []).append(pack(first, n))
    return out


def pack(start, size):
    """A place and a size below 2 ** 31 as one long; works on numbers and on columns."""
    return start * PACK + size


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, doc_id of every context."""
    schema = T._parse_datatype_string("anchor long, doc_id long")
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), pieces(batch.column(1))):
                found = np.unique(runs(no_nulls(text).encode())[0])
                held.append(found)
                ids.append(np.full(len(found), doc_id, np.int64))
                size += len(found)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(ids))], schema=arrow)
                    held, ids, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(ids))], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def contexts(docs: DataFrame, cut: bool = True, bitmap=None) -> DataFrame:
    """anchor, doc_id, hash (of the text), at (first string) and, if ``cut``, bytes of every context.

    Where ``docs`` has a column ``wanted``, only the contexts that start at
    its places are given; with a broadcast ``bitmap``, those whose anchor passes.
    """
    schema = T._parse_datatype_string("anchor long, doc_id long, hash long, at long" + ", bytes binary" * cut)
    arrow, chosen = to_arrow(schema), "wanted" in docs.columns

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(c)) for c in columns[:4]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[4], pa.binary())] if cut else arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            size = 0
            for doc_id, key, text, *wanted in zip(*(pieces(c) for c in batch.columns)):
                data = no_nulls(text).encode()
                anchor, at, many = runs(data)
                if chosen or bitmap is not None:
                    keep = np.isin(at, np.array(wanted[0], np.int64)) if chosen else passes(anchor, bitmap.value)
                    anchor, at, many = anchor[keep], at[keep], many[keep]
                columns[0].append(anchor)
                columns[1].append(np.full(len(at), doc_id, np.int64))
                columns[2].append(np.full(len(at), key, np.int64))
                columns[3].append(at)
                if cut:
                    columns[4] += [data[a:b] for a, b in zip(at.tolist(), (at + many + LENGTH - 1).tolist())]
                size += len(at)
                if size > 50_000:
                    yield batch_of(columns)
                    columns, size = [[], [], [], [], []], 0
            if size:
                yield batch_of(columns)

    return docs.select("doc_id", text_hash(docs).alias("hash"), "text", *["wanted"] * chosen).mapInArrow(run, schema)


def anchor_filter(common: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the low bits of all ``common`` anchors set, built by Spark in parts of 4 KB."""
    low = F.col("anchor").bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = (common.select((low / 32768).cast("long").alias("part"), (low % 32768).alias("bit"))
             .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        out[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(anchor: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    low = anchor & np.int64(8 * len(bitmap) - 1)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def held_contexts(docs: DataFrame, common: DataFrame) -> DataFrame:
    """The contexts of ``common`` anchors, and of few others (which are alone under their anchor and lose nothing).

    Texts are cut where a bitmap of fixed size has the anchor.  Beyond what it
    can tell apart, narrow rows meet the anchors by a shuffle, and only texts
    with such contexts are shuffled to be cut.
    """
    if common.limit(FILTER_ANCHORS + 1).count() <= FILTER_ANCHORS:
        return contexts(docs, bitmap=docs.sparkSession.sparkContext.broadcast(anchor_filter(common)))
    wanted = (contexts(docs, cut=False).join(common, "anchor").groupBy("doc_id", "hash").agg(F.collect_list("at").alias("wanted"))
              .withColumnsRenamed({"doc_id": "_doc", "hash": "_hash"}))
    texts = docs.join(wanted, (docs["doc_id"] == F.col("_doc")) & (text_hash(docs) == F.col("_hash"))).select("doc_id", "text", "wanted")
    return written(contexts(texts), "contexts")


def expanded(mixed: DataFrame) -> DataFrame:
    """anchor, context, better: runs of strings of a context (by its hash) that a smaller holder's context has, within an anchor's contexts."""
    schema = T._parse_datatype_string("anchor long, context long, better array<long>")
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def settle():
            hits = improved([h[3] for h in held], np.array([h[2] for h in held], np.int64))
            return as_batch([(held[c][0], held[c][1], o) for c, o in hits.items()], arrow)

        for batch in batches:
            for row in zip(*(pieces(c, 4096) for c in batch.columns)):
                if row[0] != last and size > BATCH_BYTES:
                    yield settle()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield settle()

    return mixed.select("anchor", "context", "first", "bytes").mapInArrow(run, schema)


def removed_strings(docs: DataFrame) -> DataFrame:
    """doc_id, hash and spans (packed start and size of removed bytes, not merged) of every document that loses some, exact copies aside."""
    common = released(docs.sparkSession, written(
        anchors(docs).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "anchors"))
    held = held_contexts(docs, common).withColumn("context", F.xxhash64("bytes"))
    distinct = released(docs.sparkSession, written(
        held.groupBy("anchor", "context", "bytes").agg(F.min("doc_id").alias("first")), "distinct"))

    counts = distinct.groupBy("anchor").agg(F.count("*").alias("c"), F.min("first").alias("lo"), F.max("first").alias("hi")).where("c > 1 AND lo < hi")
    mixed = released(docs.sparkSession, written(distinct.join(counts.select("anchor", "c"), "anchor"), "mixed"))
    few = mixed.where(f"c <= {MANY}")
    tasks = max(1, -(-few.count() // TASK_CONTEXTS), docs.sparkSession.sparkContext.defaultParallelism)
    by_expansion = expanded(few.repartition(tasks, "anchor").sortWithinPartitions("anchor", "first", "context"))
    strings = mixed.where(f"c > {MANY}").select("anchor", "context", "first", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("bytes") - LENGTH + 1), lambda j: F.col("bytes").substr(j, F.lit(LENGTH)))).alias("at", "string"))
    least = strings.groupBy("anchor", "string").agg(F.min("first").alias("least"))
    by_grouping = (strings.join(least, ["anchor", "string"]).where("least < first").groupBy("anchor", "context")
                   .agg(F.collect_list(pack(F.col("at").cast("long"), F.lit(1))).alias("better")))
    better = released(docs.sparkSession, written(by_expansion.union(by_grouping), "better"))

    # a later holder loses the whole context, its first holder the strings that a smaller document has
    known = distinct.select("anchor", "context", "first").join(better, ["anchor", "context"], "left")
    lost = (held.select("anchor", "context", "doc_id", "hash", "at", F.length("bytes").alias("n")).join(known, ["anchor", "context"])
            .where("doc_id > first OR better IS NOT NULL")
            .select("doc_id", "hash", F.when(F.col("doc_id") > F.col("first"), F.array(pack(F.col("at"), F.col("n"))))
                    .otherwise(F.transform("better", lambda x: x + F.col("at") * PACK + (LENGTH - 1))).alias("x")))
    return lost.groupBy("doc_id", "hash").agg(F.flatten(F.collect_list("x")).alias("spans"))


def kept(text: str | None, spans: list | None, whole: bool | None) -> tuple[bytes, bytes, int]:
    """The text's bytes, those kept, and the number of removed stretches."""
    data = no_nulls(text).encode()
    if whole and len(data) >= LENGTH:
        return data, b"", 1
    out, at, n = [], 0, 0
    end = -1
    for packed in sorted(spans or ()):
        s = packed // PACK
        e = s + packed % PACK
        if s > end:
            n += 1
            out.append(data[at:s])
        end = max(end, e)
        at = end
    return data, b"".join([*out, data[at:]]), n


def dedup(docs: DataFrame, row: str = "kept binary", make=lambda data, left, n: (left,)) -> DataFrame:
    """doc_id and what ``make(bytes, kept bytes, removed stretches)`` returns (columns ``row``), for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    # equal texts: all but those of the least document are gone whole
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", text_hash(rows).alias("hash"), F.xxhash64("text", F.lit(1)).alias("more"), F.octet_length("text").alias("n"))
    least = texts.groupBy("hash", "more", "n").agg(F.min("doc_id").alias("least"))
    copies = written(texts.join(least, ["hash", "more", "n"]).where(f"doc_id > least AND n >= {LENGTH}").select(
        F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")).distinct(), "copies")
    same = (rows["doc_id"] == F.col("_doc")) & (text_hash(rows) == F.col("_hash"))
    others = rows.where("doc_id IS NOT NULL").join(small(copies, BROADCAST_KEYS), same, "left_anti")
    spans = released(docs.sparkSession, written(removed_strings(others).withColumnsRenamed({"doc_id": "_doc", "hash": "_hash"}), "spans"))

    # only texts that lose a part are shuffled to meet their spans
    parted = small(spans.select("_doc", "_hash"), BROADCAST_KEYS)
    whole = rows.join(small(copies.withColumn("gone", F.lit(True)), BROADCAST_KEYS), same, "left").select("doc_id", "text", "gone")
    rest = whole.join(parted, (whole["doc_id"] == F.col("_doc")) & (text_hash(whole) == F.col("_hash")), "left_anti").withColumn(
        "spans", F.lit(None).cast(spans.schema["spans"].dataType))
    cut = rows.join(parted, same, "left_semi")
    cut = cut.join(spans, (cut["doc_id"] == F.col("_doc")) & (text_hash(cut) == F.col("_hash"))).select("doc_id", "text", F.lit(False).alias("gone"), "spans")
    return map_rows(rest.union(cut), ["doc_id", "text", "spans", "gone"], f"doc_id {kind}, {row}",
                    lambda doc_id, text, spans, gone: iter([(doc_id, *make(*kept(text, spans, gone)))]))
