"""N-gram Jaccard join with vertical partitions.

A document's set has its distinct runs of ``words`` words.  The global order
of n-grams is cut into fragments (by the leading bits of their hashes):

1. Equal sets are one class; all that follows works on classes.
2. One fragment alone already shows most classes to have no partner: a class
   whose n-grams in it that no other class has are more than the threshold
   lets a partner miss is done.
3. The others' sets are written as one segment for each fragment.  N-grams
   that two or more classes have are ordered from rare to frequent, and a
   pair can only reach the threshold if it meets in the first few of them.
4. In each such n-gram, every class is held against the class with the fewest
   n-grams of its own.  Overlaps are counted in each fragment separately and
   summed per pair.  Linked classes form clusters.
5. Pairs whose clusters differ and which met in an n-gram are verified in the
   same way; an n-gram met by one cluster alone has no such pair.  So no link
   between clusters is lost, and a group of copies costs one pair a copy.

N-grams are identified by 64-bit hashes (two of a pair's n-grams collide with
a probability near 1e-14).

A null text and one without words have an empty set and link with nothing; a
text shorter than an n-gram is one n-gram.  Rows with equal sets link,
repeated rows included; a null doc_id takes part but is never a component's
name, unless all are null.  The least doc_id names a component, so ties do not
arise.  Long texts are read whole.  Extra columns never reach the worker; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, map_rows, no_nulls, pieces, small, to_arrow, written
from .components import components

WORDS, PERCENT = 4, 85
#: Fragments of the global order, a power of two; the first one is used to leave out classes without a partner.
FRAGMENTS = 4
#: Words whose hashes a worker remembers at a time.
MEMORY = 400_000
#: At most so many class keys (three numbers each) are broadcast to pick texts.
BROADCAST_CLASSES = 1_000_000
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                   0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9))


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


class Grams:
    """Distinct n-gram hashes of texts, ascending as unsigned numbers."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: ASCII letters and white space only
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)] if words else [], np.uint64)
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = len(h) - self.words + 1
        mixed = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.words):
                mixed += h[k:k + n] * ODD[k % len(ODD)] + np.uint64(k)
                mixed ^= mixed >> np.uint64(31)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * ODD[7]
            mixed = (mixed ^ (mixed >> np.uint64(27))) * ODD[6]
        return np.unique(mixed ^ (mixed >> np.uint64(31)))


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two longs."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n (size of the set), k1 and k2 (its key) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(doc_id, text_hash, text, grams=Grams(words)):
        found = grams.of(no_nulls(text))
        yield (doc_id, text_hash, len(found), *(set_key(found) if len(found) else (0, 0)))

    rows_in = docs.select("doc_id", text_hash(docs).alias("text_hash"), "text")
    return map_rows(rows_in, ["doc_id", "text_hash", "text"], f"doc_id {kind}, text_hash long, n long, k1 long, k2 long", rows)


def first_fragment(docs: DataFrame, words: int, fragments: int) -> DataFrame:
    """gram, k1: the n-grams of every row in the first fragment of the global order."""
    schema = T._parse_datatype_string("gram long, k1 long")
    arrow, bits = to_arrow(schema), 64 - (fragments.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(words)
        for batch in batches:
            held, keys, size = [], [], 0
            for text in pieces(batch.column(0)):
                found = grams.of(no_nulls(text))
                part = found[: np.searchsorted(found, np.uint64(1 << bits))] if bits < 64 else found
                if len(part):
                    held.append(part.astype(np.int64))
                    keys.append(np.full(len(part), set_key(found)[0], np.int64))
                    size += len(part)
                if size > 200_000:
                    yield _columns(held, keys, arrow)
                    held, keys, size = [], [], 0
            if held:
                yield _columns(held, keys, arrow)

    return docs.select("text").mapInArrow(run, schema)


def _columns(held: list[np.ndarray], keys: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(keys))], schema=schema)


def segments(docs: DataFrame, chosen: DataFrame, words: int, fragments: int) -> DataFrame:
    """k1, n, fragment, grams: the sets of the chosen classes (doc_id, k1), one row for each fragment that has n-grams."""
    schema = T._parse_datatype_string("k1 long, n long, fragment int, grams array<long>")
    shift = np.uint64(64 - (fragments.bit_length() - 1)) if fragments > 1 else None

    def rows(text, k1, grams=Grams(words)):
        found = grams.of(no_nulls(text))
        if len(found) and set_key(found)[0] == k1:  # another row may have the same doc_id
            place = (found >> shift).astype(int) if shift is not None else np.zeros(len(found), int)
            for f in np.unique(place):
                yield k1, len(found), int(f), found[place == f].astype(np.int64)

    texts = docs.select("doc_id", "text").join(chosen, docs["doc_id"].eqNullSafe(chosen["_doc"])).select("text", "k1")
    return map_rows(texts, ["text", "k1"], schema, rows)


def overlap_needed(n: str, m: str, percent: int) -> str:
    """SQL: the least overlap with which sets of n and m n-grams link."""
    return f"ceil({percent} * ({n} + {m}) / {100 + percent}D - 1e-9)"


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted by fragment, then summed."""
    left = parts.select(F.col("k1").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("g_a"))
    right = parts.select(F.col("k1").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("g_b"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("common"))
    return (met.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
            .where(f"100 * common >= {percent} * (n_a + n_b - common)").select("a", "b"))


def links(docs: DataFrame, sigs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """a, b: enough links between classes (by k1) to connect every class with all that it links to."""
    classes = sigs.where("n > 0").groupBy("k1", "n").agg(F.min("doc_id").alias("_doc"))
    own = (first_fragment(docs, words, fragments).groupBy("gram").agg(F.min("k1").alias("k1"), F.max("k1").alias("last"))
           .where("k1 = last").groupBy("k1").agg(F.count("*").alias("own")))
    left = written(classes.join(own, "k1", "left").where(f"100 * (n - coalesce(own, 0)) >= {percent} * n").select("_doc", "k1"), "classes")
    parts = written(segments(docs, small(left, BROADCAST_CLASSES), words, fragments).dropDuplicates(["k1", "fragment"]), "segments")

    posts = parts.select("k1", "n", F.explode("grams").alias("gram"))
    shared = posts.groupBy("gram").agg(F.count("*").alias("freq")).where("freq > 1")
    # all grams that others have, from rare to frequent; as many of the first as a partner cannot all miss
    held = (posts.join(shared, "gram").groupBy("k1", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "gram"))).alias("grams"))
            .withColumn("v", F.size("grams")).withColumn("first", F.expr(f"CAST(v - ceil({percent} * n / 100D - 1e-9) + 1 AS INT)")))
    heads = written(held.select("k1", "n", "v", F.expr("CASE WHEN first > 0 THEN slice(grams, 1, first) END").alias("grams")), "heads")
    met = heads.select("k1", "n", "v", F.posexplode_outer("grams").alias("pos", "g")).where("g IS NOT NULL").select(
        F.col("g.gram").alias("gram"), "pos", "k1", "n", "v")

    def candidates(x: DataFrame, y: DataFrame, test: str) -> DataFrame:
        """Pairs in an n-gram that could reach the threshold by what follows it in both."""
        able = f"least(x.v - x.pos, y.v - y.pos) >= {overlap_needed('x.n', 'y.n', percent)}"
        return (x.alias("x").join(y.alias("y"), F.expr(f"x.gram = y.gram AND x.k1 <> y.k1 AND {able} AND ({test})"))
                .selectExpr("least(x.k1, y.k1) AS a", "greatest(x.k1, y.k1) AS b").distinct())

    purest = met.groupBy("gram").agg(F.max(F.struct((F.col("v") / F.col("n")).alias("share"), "k1", "pos", "n", "v")).alias("p")).select(
        "gram", "p.k1", "p.pos", "p.n", "p.v")
    first = written(verified(candidates(met, purest, "true"), parts, percent), "links")

    roots = components(first, "clusters")
    posted = met.join(roots, met["k1"] == roots["node"], "left").select("gram", "pos", "k1", "n", "v", F.coalesce("root", "k1").alias("root"))
    counts = posted.groupBy("gram", "root").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("gram").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select(
        "gram", F.col("top.root").alias("top"))
    open_ = written(posted.join(mixed, "gram"), "open")
    second = verified(candidates(open_.where("root <> top"), open_, "x.root <> y.root AND (y.root = y.top OR x.k1 < y.k1)"), parts, percent)
    return first.union(second)


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row of ``docs``."""
    sigs = written(signatures(docs, words), "signatures")
    roots = components(links(docs, sigs, words, percent, fragments))
    classes = sigs.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, classes["k1"] == roots["node"], "left").withColumn("root", F.coalesce("root", "k1"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").selectExpr("k1 AS c1", "k2 AS c2", "component_id")
    return (sigs.join(named, (sigs["n"] > 0) & (sigs["k1"] == named["c1"]) & (sigs["k2"] == named["c2"]), "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return linked(docs, words, percent).drop("text_hash")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of the least doc_id of each component; all columns kept.

    Rows without words are in no group and stay.  Of rows with equal doc_id
    and text one stays.  Rows without a doc_id stay where their whole
    component has none.
    """
    found = written(linked(docs, words, percent).where("n_shingles > 0"), "components")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    names = free_names(docs, "_doc", "_hash")
    same_row = docs["doc_id"].eqNullSafe(F.col(names[0])) & (text_hash(docs) == F.col(names[1]))
    losers = found.where(~kept).select("doc_id", "text_hash").distinct().toDF(*names)
    out = docs.join(small(losers, BROADCAST_CLASSES), same_row, "left_anti")
    twice = found.where(kept).groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "text_hash").toDF(*names)
    if twice.isEmpty():
        return out
    twice = small(twice, BROADCAST_CLASSES)
    return out.join(twice, same_row, "left_anti").union(out.join(twice, same_row, "left_semi").dropDuplicates(["doc_id", "text"]))
