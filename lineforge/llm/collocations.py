"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word occurrence with its lead
columns, the next words of its piece, padded where the piece ends.  The
occurrences of a shorter phrase are exactly the windows that begin with it,
so Spark's ROLLUP over the window's columns sums all shorter counts from
those of the longest windows; no n-gram length is exploded on its own.

A task turns texts into word numbers and counts equal windows before anything
is shuffled.  Words travel as 64-bit hashes: the distinct words of each
language are counted first, and a seed is taken under which no two words of a
language share a hash, so counts are exact.  Windows of one prefix (all words
but the last) meet in one task; those whose prefix holds only very common
words are dealt by their last word too, into as many parts as the rarest of
these words asks for, so no task gets far more than its share.  There a
window too rare to be a candidate gives its count to its prefix, and a prefix
too rare gives it to the words before, so the ROLLUP moves little.  A word too
rare to be in any candidate ends a window as a piece's end does; tasks know
such words by a bitmap of hashes of fixed size, in which a rare word that is
taken for a frequent one costs a window and changes no result.

Candidates are cut at every place; the least floored score counts, the
leftmost cut on ties.  Arithmetic is in 38-digit decimals, exact while
1000000 * a * a has at most 38 digits.  Ranking first thins each language's
candidates in many groups, then ranks the survivors.

A null text is empty, a null language is ``und`` (and meets rows that say
so); repeated rows count again; a very long text is cut into windows some
megabytes at a time; ties rank by phrase in UTF-8 byte order; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import no_nulls, pieces, to_arrow, written

MAX_WORDS = 3
MIN_COUNT = 10
#: A phrase goes where a longer candidate around it has at least this percentage of its count.
COVER_PERCENT = 50
TOP = 2000
#: Words whose windows are counted together in a task (32 MB of numbers, as much again to sort).
WORDS_AT_ONCE = 4 << 20
#: Bytes of a long text that become words at once.
BYTES_AT_ONCE = 8 << 20
#: Groups of a language's candidates that are thinned to the first ``TOP`` before the ranking.
SALTS = 256
#: What ends a piece; ``.`` stands for all of them, as no word can hold it.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(ENDS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(ENDS) + b" abcdefghijklmnopqrstuvwxyz")
#: A word is very common when it is more than one in so many of all words; there can be no more such words than this.
COMMON = 4096
#: Leading bits of a hash in the bitmap of frequent words (16 MB), and bits in one of its rows.
BITMAP_BITS, ROW_BITS = 27, 32_768
#: Seeds that are tried; a billion words clash under one of 35.
SEEDS = 64
#: Padding of a window, and the hash that no word may have.
PAD = 0
DECIMAL = "decimal(38,0)"


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``b"."`` between pieces; a long text in several lists cut between pieces."""
    data = text.encode("utf-8", "surrogatepass").translate(TABLE)
    while data:
        cut = len(data) if len(data) <= BYTES_AT_ONCE else (data.find(b".", BYTES_AT_ONCE) + 1 or len(data))
        part, data = data[:cut], data[cut:]
        yield part.replace(b".", b" . ").split()  # of ASCII white space only the blank is left


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: every task counts its own words before the shuffle."""
    schema = T._parse_datatype_string("lang string, word string, n long")
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def drained() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(b".", None)
                words, n = list(c), list(c.values())
                for at in range(0, len(words), 1 << 16):
                    part = words[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                                                      pa.array(n[at:at + (1 << 16)], pa.int64())], schema=arrow)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), pieces(batch.column(1))):
                for words in words_of(no_nulls(text)):
                    counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > 1 << 20:
                yield from drained()
        yield from drained()

    return docs.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hash_of(word: bytes, seed: int) -> int:
    """The word's 64-bit hash as a signed number."""
    h = xxhash.xxh3_64_intdigest(word, seed)
    return h - (1 << 64) if h >> 63 else h


def hashed(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` with their hashes ``h`` under the first seed that keeps a language's words apart, and that seed."""
    def under(seed: int):
        return F.pandas_udf(lambda word: word.map(lambda w: hash_of(w.encode("utf-8", "surrogatepass"), seed)), "long")

    words = written(words, "words")
    for seed in range(SEEDS):
        out = written(words.withColumn("h", under(seed)("word")), "hashed")
        clash = out.groupBy("lang", "h").agg(F.count("*").alias("k")).where(f"k > 1 OR h = {PAD}")
        if clash.limit(1).count() == 0:
            return out, seed
    raise RuntimeError("no seed keeps the words' hashes apart")


def common_words(words: DataFrame) -> tuple[dict[tuple[str, int], int], int]:
    """(lang, hash) -> count of the very common words, ``COMMON`` at most, and the count beyond which a word is one."""
    total = words.agg(F.sum("n")).first()[0] or 0
    share = total // COMMON + 1
    return {(r.lang, r.h): r.n for r in words.where(F.col("n") > share).select("lang", "h", "n").collect()}, share


def frequent_bits(words: DataFrame, least: int) -> np.ndarray:
    """The bitmap, as bytes, of the hashes of words that occur ``least`` times."""
    at = F.shiftrightunsigned("h", 64 - BITMAP_BITS).cast("long")
    rows = words.where(F.col("n") >= least).groupBy(F.floor(at / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(at % ROW_BITS).alias("bits"))
    bits = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for r in rows.toLocalIterator():
        bits[r.row * ROW_BITS // 8:(r.row + 1) * ROW_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def may_be_frequent(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def windows(docs: DataFrame, words: DataFrame, seed: int, order: int = MAX_WORDS, least: int = MIN_COUNT) -> DataFrame:
    """lang, w1..wN (hashes of a word and the words after it in its piece, padded), part, c: counted within each task.

    ``part`` is 0, or from 1 on where all words of the prefix are very common.
    Rare words' own windows are padded whole.
    """
    common, share = common_words(words)
    bits = docs.sparkSession.sparkContext.broadcast(frequent_bits(words, least))
    names = [f"w{k + 1}" for k in range(order)]
    schema = T._parse_datatype_string("lang string, " + ", ".join(f"{n} long" for n in names) + ", part long, c long")
    arrow = to_arrow(schema)

    class Numbers(dict):
        """Numbers of words in the order in which a task meets them; the piece mark is 0."""

        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            return n

    def counted(lang: str, parts: list[np.ndarray], number: Numbers) -> Iterator[pa.RecordBatch]:
        hashes = np.array([PAD, *(hash_of(w, seed) for w in list(number)[1:])], np.int64)
        ids = np.concatenate([*parts, np.zeros(order, np.int64)])
        rare = ~may_be_frequent(hashes, bits.value)
        rare[0] = False
        alone = int(np.count_nonzero(rare[ids]))
        ids[rare[ids]] = 0
        first = ids[:len(ids) - order]
        lead, open_ = [first], np.ones(len(first), bool)
        for k in range(1, order):
            nxt = ids[k:len(ids) - order + k]
            open_ &= nxt != 0
            lead.append(np.where(open_, nxt, 0))
        wide = max(1, (len(number) - 1).bit_length())
        if wide * order <= 63:  # all words of a window fit one number: one sort
            key = np.zeros(len(first), np.int64)
            for column in lead:
                key = key << wide | column
            key, c = np.unique(key[first != 0], return_counts=True)
            lead = [key >> wide * (order - 1 - k) & (1 << wide) - 1 for k in range(order)]
        else:
            rows, c = np.unique(np.stack(lead, 1)[first != 0], axis=0, return_counts=True)
            lead = [rows[:, k] for k in range(order)]
        if alone:
            lead, c = [np.append(column, 0) for column in lead], np.append(c, alone)
        often = np.array([common.get((lang, h), 0) for h in hashes.tolist()], np.int64)
        for at in range(0, len(c), 1 << 16):
            rows = slice(at, at + (1 << 16))
            n = len(c[rows])
            w = [hashes[column[rows]] for column in lead]
            # a prefix occurs no more often than its rarest word
            parts = np.minimum.reduce([often[column[rows]] for column in lead[:-1]] or [np.zeros(n, np.int64)]) // share
            part = np.where(parts > 1, w[-1] % np.maximum(parts, 1) + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), *map(pa.array, w), pa.array(part), pa.array(c[rows].astype(np.int64))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        size = 0

        def drained() -> Iterator[pa.RecordBatch]:
            while held:
                lang, (number, parts) = held.popitem()
                yield from counted(lang, parts, number)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), pieces(batch.column(1))):
                if lang not in held:
                    held[lang] = Numbers({b".": 0}), []
                number, parts = held[lang]
                for words in words_of(no_nulls(text)):
                    parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                    size += len(words) + 1
                parts.append(np.zeros(1, np.int64))  # windows end with their document
                if size > WORDS_AT_ONCE:
                    yield from drained()
                    size = 0
        yield from drained()

    return docs.select("lang", "text").mapInArrow(run, schema)


def frequencies(docs: DataFrame, words: DataFrame, seed: int, order: int = MAX_WORDS, least: int = MIN_COUNT) -> DataFrame:
    """lang, w1..wN, size, f: every phrase of at most N words that occurs ``least`` times, and (size 0) each language's words.

    All rows of a prefix and part lie in one task from the first shuffle on.
    Each window's sum is laid down once for its prefix (last word padded)
    and, where it is a candidate, once in full; a prefix that is rare gives
    up its own last word.  The ROLLUP sums the prefix rows; full rows pass
    through it at the top level alone.
    """
    names = [f"w{k + 1}" for k in range(order)]
    last, prefix = names[-1], names[:-1]
    place = ["lang", *prefix, "part"]
    top = (windows(docs, words, seed, order, least).repartition(*place)
           .groupBy(*place, last).agg(F.sum("c").alias("c")))
    full, pad = F.col(last), F.lit(PAD).cast("long")
    laid = F.when((F.col("c") >= least) & (full != PAD), F.array(full, pad)).otherwise(F.array(pad))
    sums = top.select(*place, F.explode(laid).alias(last), "c").groupBy(*place, last).agg(F.sum("c").alias("c"))
    if prefix:
        rare = (full == PAD) & (F.col("part") == 0) & (F.col("c") < least)
        sums = sums.withColumn(prefix[-1], F.when(rare, pad).otherwise(F.col(prefix[-1])))
    columns = ", ".join(names)
    sizes = " + ".join(f"grouping({n})" for n in names)
    sums = docs.sparkSession.sql(f"""
        SELECT lang, {columns}, {order} - ({sizes}) AS size,
          sum(c) FILTER (WHERE {last} = {PAD}) AS shorter, sum(c) FILTER (WHERE {last} <> {PAD}) AS longest
        FROM {{sums}} GROUP BY lang, ROLLUP ({columns})""", sums=sums)
    sums = sums.select("lang", *names, "size", F.when(F.col("size") == order, F.col("longest")).otherwise(F.col("shorter")).alias("f"))
    # a padded column repeats a part of the count of a shorter phrase
    real = F.col("size") == 0
    for k, n in enumerate(names):
        real = real | ((F.col("size") == k + 1) & (F.col(n) != PAD) & (F.col("f") >= least))
    return written(sums.where(real), "frequencies")


def candidates(freq: DataFrame, order: int = MAX_WORDS, cover: int = COVER_PERCENT) -> DataFrame:
    """lang, w1..wN, size, a, l, r, score of the candidates that no longer one covers."""
    names = [f"w{k + 1}" for k in range(order)]
    of = {k: freq.where(F.col("size") == k).select("lang", *names[:k], "f") for k in range(1, order + 1)}
    out = []
    for size in range(2, order + 1):
        rows = of[size].withColumnRenamed("f", "a")
        for k in range(1, size):  # every part of a candidate is at least as frequent, so it has a row
            left = of[k].withColumnRenamed("f", f"l{k}")
            right = of[size - k].select("lang", *[F.col(names[j]).alias(names[k + j]) for j in range(size - k)], F.col("f").alias(f"r{k}"))
            rows = rows.join(left, ["lang", *names[:k]]).join(right, ["lang", *names[k:size]])
        around = None
        for longer in range(size + 1, order + 1):
            for at in range(longer - size + 1):
                inner = of[longer].select("lang", *[F.col(names[at + j]).alias(names[j]) for j in range(size)], F.col("f").alias("cover"))
                around = inner if around is None else around.union(inner)
        if around is not None:
            around = around.groupBy("lang", *names[:size]).agg(F.max("cover").alias("cover"))
            rows = rows.join(around, ["lang", *names[:size]], "left").where(f"cover IS NULL OR 100 * cover < {cover} * a")
        cuts = F.array(*[F.struct(score_of(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                                  F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)])
        rows = rows.withColumn("cut", F.array_min(cuts))
        out.append(rows.select("lang", *names[:size], *[F.lit(PAD).cast("long").alias(n) for n in names[size:]], F.lit(size).alias("size"),
                               "a", "cut.l", "cut.r", "cut.score"))
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    return every


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact; at most 1000000 as both parts are as frequent as the phrase."""
    a, left, right = (x.cast("decimal(18,0)") for x in (a, left, right))
    return F.call_function("div", (a * a * F.lit(1_000_000).cast("decimal(7,0)")).cast(DECIMAL), (left * right).cast(DECIMAL))


def spelled(found: DataFrame, words: DataFrame, order: int = MAX_WORDS) -> DataFrame:
    """``found`` with its words as one ``phrase``, joined by blanks."""
    for k in range(order):
        names = words.select("lang", F.col("h").alias(f"w{k + 1}"), F.col("word").alias(f"word{k + 1}"))
        found = found.join(names, ["lang", f"w{k + 1}"], "inner" if k < 2 else "left")
    return found.withColumn("phrase", F.concat_ws(" ", *[f"word{k + 1}" for k in range(order)]))


def ranked(found: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase, with their ``rank``."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    thinned = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    thinned = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return (thinned.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top))


def mine(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, order: int = MAX_WORDS, cover: int = COVER_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``order`` words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words, seed = hashed(word_counts(texts))
    freq = frequencies(texts, words, seed, order, least)
    frequent = words.where(F.col("n") >= least).select("lang", "h", "word")
    best = ranked(spelled(candidates(freq, order, cover), frequent, order), top)
    totals = freq.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
