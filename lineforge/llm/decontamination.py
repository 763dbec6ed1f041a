"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers, and names (capitalised words inside a sentence)
become typed placeholders; all other words are lower-cased and lose their
punctuation; white space is one blank and a number keeps its separators.
Windows of ``WINDOW`` canonical words of a document are hash-joined with those
of the benchmark.  Windows that match at one shift of a document against an
item must fill the item's slots consistently: a name or unit that no filling
has in most of its places costs its windows; a number that has such a filling
costs the windows where it has another (without one, equal numbers of a
question were not one variable, and each place fills freely).  A document is
contaminated by an item when consistent matches cover ``MIN_SHARE`` of the
item's windows, or ``MIN_RUN`` words on end at one shift.

Windows with a placeholder count a second time as they stand, so that case,
an edited name or a lack of plain words hide no verbatim copy: matches of
plain lower-cased words are held to the same share and run.  An item of fewer
words than a window is matched as one sequence of words; one of fewer than
``MIN_LITERAL`` words is common speech, and matches only a text that holds
nothing else.

All documents are read once, for *proposals*: documents and items with a
common window.  A window in more than ``COMMON`` items does not propose an
item whose common windows alone reach neither share nor run, so a turn that
thousands of questions share makes no rows.  Only proposed documents are read
again, and all windows of the pair are verified.

A null text is empty and matches nothing; an empty table on either side gives
no rows.  Rows with equal doc_id (null included) and text count as one
document.  Ties do not arise: every item that reaches the share is reported.
Extra columns are dropped before the join; ``clean_documents`` passes all
columns through.  Texts are matched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, small, written

WINDOW, MIN_LITERAL, MIN_SHARE = 5, 3, 0.5
#: So many matched words on end are a leak whatever the item's length.
MIN_RUN = 13
#: A window in more items than this proposes only items that need it.
COMMON = 64
#: Benchmark windows (numbers only, about 100 bytes each), proposals and flagged documents are broadcast up to so many rows.
BROADCAST_WINDOWS, BROADCAST_PAIRS, BROADCAST_FLAGGED = 500_000, 500_000, 1_000_000

# Units that follow a number.
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs ms ns hz khz mhz ghz w kw v mv a ma n j kj kb mb gb tb "
         "percent pct degrees degree celsius fahrenheit meters metres kilometers kilometres miles feet inches grams kilograms pounds "
         "ounces liters litres gallons seconds minutes hours days weeks months years dollars cents euros usd eur gbp").split()
NAME, NUMBER, POINT = "\u0001", "\u0002", "\u0003"
#: Kinds of a window: without placeholder, as template, as it stands, a whole short item.
BOTH, TEMPLATE, LITERAL, SHORT = range(4)
#: The low two bits of a slot's value.
IS_NAME, IS_NUMBER, IS_UNIT = 1, 2, 3
FILLED = "array<struct<at:int,item:bigint,doc:bigint>>"
KEYS = ["doc_id", "text_hash"]


def marked(text: Column) -> Column:
    """Words separated by blanks; names and numbers begin with their mark, all is lower case, a number is one word without its sign."""
    # runs of white space other than one blank
    even = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:[\p{Z}\s&&[^ ]]| (?=[\p{Z}\s]))[\p{Z}\s]*", " ")
    # a capitalised word after a word or comma, not at the start of a sentence
    named = F.regexp_replace(even, r"(?<=[\p{Ll}\p{Nd},;] )(?=\p{Lu}\p{Ll})", NAME)
    joined = F.regexp_replace(named, r"[.,](?<=\p{Nd}[.,])(?=\p{Nd})", POINT)
    numbered = F.regexp_replace(joined, rf"\p{{Nd}}[\p{{Nd}}{POINT}]*", f" {NUMBER}$0 ")
    return F.regexp_replace(F.lower(numbered), rf"[^\p{{L}}\p{{Nd}}{NAME}{NUMBER}{POINT} ]+", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(marked(text), " +"), lambda w: (w != "") & (w != NAME))


def kind_of(word: Column, before: Column) -> Column:
    """0 for a plain word, else the kind of its placeholder."""
    return (F.when(word.startswith(NUMBER), IS_NUMBER).when(word.startswith(NAME), IS_NAME)
            .when(word.isin(UNITS) & F.coalesce(before.startswith(NUMBER), F.lit(False)), IS_UNIT).otherwise(0))


def hashed_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and, per word of ``text``: l (hash of the word), k (kind), t (hash of its canonical form)."""
    # no filter stands on a computed array, and none is inferred from an outer generator: the optimiser
    # would push it down and compute the array again inside each lambda call
    tokens = rows.select(*keys, words(F.col("text")).alias("w"))
    kinds = tokens.select(*keys, "w", F.transform("w", lambda w, i: kind_of(w, F.get("w", i - 1))).alias("k"))
    literal = kinds.select(*keys, "k", F.transform("w", lambda w: F.xxhash64(F.translate(w, NAME + NUMBER, ""))).alias("l"))
    return literal.select(*keys, "k", "l", F.transform("l", lambda h, i: F.when(F.get("k", i) == 0, h).otherwise(F.get("k", i).cast("long"))).alias("t"))


def runs(hashes: str, n: int, where=None) -> Column:
    """Hash of each run of ``n`` numbers of an array; null where ``where(place)`` does not hold."""
    one = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])
    spots = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), one if where is None else lambda i: F.when(where(i), one(i)))
    return F.when(F.size(hashes) >= n, spots).otherwise(F.array().cast("array<bigint>"))


def has_slot(i: Column, window: int) -> Column:
    return reduce(lambda a, b: a | b, [F.get("k", i + k) > 0 for k in range(window)])


def short_runs(n: int) -> Column:
    """Hashes of runs of ``n`` words; of a whole text only, where so few words are common speech."""
    found = runs("l", n)
    return found if n >= MIN_LITERAL else F.when(F.size("l") == n, found).otherwise(F.array().cast("array<bigint>"))


def window_hashes(docs: DataFrame, keys: list[str], window: int, lengths: list[int]) -> DataFrame:
    """keys and hash of every window of a text, of any kind."""
    w = hashed_words(docs, keys)
    literal = F.when(F.exists("k", lambda k: k > 0), runs("l", window, lambda i: has_slot(i, window))).otherwise(F.array().cast("array<bigint>"))
    return w.select(*keys, F.explode(F.concat(runs("t", window), literal, *[short_runs(n) for n in lengths])).alias("hash"))


def windows(rows: DataFrame, keys: list[str], window: int, lengths: list[int]) -> DataFrame:
    """keys, n_words, place, hash, slots and kind of every window.

    ``slots`` has a number for each word of a template: 0 for a plain one,
    else its hash with its kind in the low bits; null without a placeholder.
    """
    w = hashed_words(rows, keys)
    w = w.select(*keys, "t", "l", "k", F.zip_with("l", "k", lambda h, k: F.when(k == 0, 0).otherwise(
        F.shiftleft(F.shiftright(h, 2), 2).bitwiseOR(k.cast("long")))).alias("v"))
    spot = lambda i, h, slots, kind: F.struct(i.alias("place"), h.alias("hash"), slots.alias("slots"), kind.alias("kind"))
    none = F.lit(None).cast("array<bigint>")

    def each(n: int, make) -> Column:
        spots = F.transform(F.sequence(F.lit(0), F.size("l") - n), make)
        return F.when(F.size("l") >= n, spots).otherwise(F.array().cast("array<struct<place:int,hash:bigint,slots:array<bigint>,kind:int>>"))

    at = lambda hashes, i, n: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])
    kinds = [each(window, lambda i: spot(i, at("t", i, window), F.when(has_slot(i, window), F.slice("v", i + 1, F.lit(window))),
                                         F.when(has_slot(i, window), TEMPLATE).otherwise(BOTH))),
             each(window, lambda i: F.when(has_slot(i, window), spot(i, at("l", i, window), none, F.lit(LITERAL))))]
    def short(n: int) -> Column:
        found = each(n, lambda i: spot(i, at("l", i, n), none, F.lit(SHORT)))
        return found if n >= MIN_LITERAL else F.when(F.size("l") == n, found).otherwise(F.slice(found, 1, 0))

    kinds += [short(n) for n in lengths]
    return w.select(*keys, F.size("l").alias("n_words"), F.inline_outer(F.concat(*kinds))).where("hash IS NOT NULL")


def has_run(places: Column, window: int) -> Column:
    """Whether matched windows cover ``MIN_RUN`` words on end."""
    n = MIN_RUN - window + 1
    return F.exists(places, lambda p: F.size(F.array_intersect(places, F.sequence(p, p + (n - 1)))) == n)


def benchmark_windows(benchmark: DataFrame, window: int, min_share: float) -> tuple[DataFrame, list[int]]:
    """Windows of the items, written, and the lengths of the items that are shorter than a window.

    item_id, item_place, hash, item_slots, kind, n_template (usable template
    windows of the item), n_literal (windows as they stand), proposes.
    """
    items = written(benchmark.select("item_id", "text").withColumn("n", F.size(words(F.col("text")))), "items")
    lengths = sorted(r.n for r in items.where(F.col("n").between(1, window - 1)).select("n").distinct().collect())  # window - 1 numbers at most
    found = windows(items.where(F.col("n") >= window), ["item_id"], window, [])
    for n in lengths:
        found = found.union(windows(items.where(F.col("n") == n), ["item_id"], window, [n]))
    # a template needs some plain words
    plain = F.coalesce(F.size(F.filter("slots", lambda v: v == 0)), F.lit(window))
    found = found.where((F.col("kind") != TEMPLATE) | (plain >= MIN_LITERAL)).select(
        "item_id", F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots"), "kind").distinct()
    common = found.groupBy("hash").agg(F.countDistinct("item_id").alias("items")).where(F.col("items") > COMMON).select("hash", F.lit(True).alias("common"))
    found = found.join(common, "hash", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    totals = found.groupBy("item_id").agg(*[x for name, kinds in (("template", (BOTH, TEMPLATE)), ("literal", (BOTH, LITERAL))) for x in (
        F.count_if(F.col("kind").isin(*kinds)).alias(f"n_{name}"),
        F.sort_array(F.collect_set(F.when(F.col("common") & F.col("kind").isin(*kinds), F.col("item_place")))).alias(f"common_{name}"))])
    enough = [(F.size(f"common_{x}") >= min_share * F.col(f"n_{x}")) & (F.size(f"common_{x}") > 0) | has_run(F.col(f"common_{x}"), window) for x in ("template", "literal")]
    totals = totals.withColumn("needs", enough[0] | enough[1]).drop("common_template", "common_literal")
    found = found.join(totals, "item_id").withColumn("proposes", ~F.col("common") | F.col("needs") | (F.col("kind") == SHORT))
    return written(found.drop("common", "needs"), "benchmark-windows"), lengths


def agreeing(spots: Column) -> Column:
    """The rows of ``spots`` (item_place, filled) of a shift whose slots are filled consistently.

    A name or unit that no filling has in most of its places is torn in all of
    them; a number that has such a filling is torn where it has another.
    """
    fills = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.coalesce(s["filled"], F.array().cast(FILLED)))))
    most = lambda g: (2 * F.size(F.filter(fills, lambda h: (h["item"] == g["item"]) & (h["doc"] == g["doc"])))
                      > F.size(F.filter(fills, lambda h: h["item"] == g["item"])))
    settled = F.transform(F.filter(fills, most), lambda g: F.struct(g["item"].alias("item"), g["doc"].alias("doc")))
    values = F.transform(settled, lambda g: g["item"])
    torn = F.filter(fills, lambda f: F.when(f["item"].bitwiseAND(F.lit(3)) == IS_NUMBER, F.array_contains(values, f["item"]) & ~F.array_contains(
        settled, F.struct(f["item"].alias("item"), f["doc"].alias("doc")))).otherwise(~F.array_contains(values, f["item"])))
    return F.filter(spots, lambda s: s["filled"].isNull() | ~F.arrays_overlap(s["filled"], torn))


def proposals(rows: DataFrame, items: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """doc_id, text_hash, item_id of documents and items that share a proposing window."""
    wanted = small(items.where("proposes").select("hash", "item_id").distinct(), BROADCAST_WINDOWS)
    return window_hashes(rows, KEYS, window, lengths).join(wanted, "hash").select(*KEYS, "item_id").distinct()


def same_text(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the given doc_id (null included) and text_hash."""
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return rows.join(small(keys, BROADCAST_FLAGGED), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_hash"] == F.col("_hash")), "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """Every common window of a proposed document and item: keys, item_id, kinds, places, slots and the item's totals; written."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    items, lengths = benchmark_windows(benchmark, window, min_share)
    pairs = written(proposals(rows, items, window, lengths), "proposals")
    found = windows(same_text(rows, pairs).dropDuplicates(KEYS), KEYS, window, lengths).withColumnRenamed("kind", "doc_kind")
    # the windows that a pair's item has, looked up in its document
    asked = small(pairs, BROADCAST_PAIRS).join(items, "item_id").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "hash": "_window"})
    return written(found.join(asked, found["doc_id"].eqNullSafe(asked["_id"]) & (found["text_hash"] == asked["_hash"]) & (found["hash"] == asked["_window"]))
                   .drop("_id", "_hash", "_window"), "matches")


def contaminated(met: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, text_hash, item_id, n_matched, n_windows, share, n_slots, reparameterised of each pair whose templates agree."""
    met = met.where(F.col("kind").isin(BOTH, TEMPLATE) & F.col("doc_kind").isin(BOTH, TEMPLATE))
    filled = F.when(F.col("slots").isNotNull(), F.filter(F.transform(
        F.arrays_zip("item_slots", "slots"), lambda x, i: F.struct((F.col("item_place") + i).alias("at"), x["item_slots"].alias("item"),
                                                                   x["slots"].alias("doc"))), lambda x: x["item"] != 0))
    # one group holds at most one row per window of an item: a shift fixes the document's place
    shifts = met.withColumn("filled", filled).groupBy(*KEYS, "item_id", "n_template", (F.col("place") - F.col("item_place")).alias("shift"))
    kept = shifts.agg(agreeing(F.collect_set(F.struct("item_place", "filled"))).alias("spots")).where(F.size("spots") > 0)
    by_shift = kept.select(*KEYS, "item_id", F.col("n_template").alias("n_windows"), F.transform("spots", lambda s: s["item_place"]).alias("places"),
                           F.array_distinct(F.transform(F.flatten(F.transform("spots", lambda s: F.coalesce(s["filled"], F.array().cast(FILLED)))),
                                                        lambda f: F.struct(f["item"].alias("item"), f["doc"].alias("doc")))).alias("filled"))
    return reaching(by_shift, window, min_share, F.max(F.size("filled")).alias("n_slots"),
                    F.max(F.exists("filled", lambda x: x["item"] != x["doc"])).alias("reparameterised"))


def reaching(by_shift: DataFrame, window: int, min_share: float, *more: Column) -> DataFrame:
    """Pairs whose matched ``places``, over all shifts, reach the share, or at one shift make a run."""
    return (by_shift.groupBy(*KEYS, "item_id", "n_windows")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("bigint").alias("n_matched"),
                 F.max(has_run(F.col("places"), window)).alias("run"), *more)
            .withColumn("share", F.col("n_matched") / F.col("n_windows")).where((F.col("share") >= min_share) | F.col("run")).drop("run"))


def copied(met: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, text_hash, item_id, n_matched, n_windows, share of each pair that shares the item's words as they stand."""
    stands = met.where(F.col("kind").isin(BOTH, LITERAL) & F.col("doc_kind").isin(BOTH, LITERAL))
    by_shift = (stands.groupBy(*KEYS, "item_id", F.col("n_literal").alias("n_windows"), (F.col("place") - F.col("item_place")).alias("shift"))
                .agg(F.collect_set("item_place").alias("places")))
    one = F.lit(1).cast("bigint")
    short = met.where((F.col("kind") == SHORT) & (F.col("doc_kind") == SHORT)).select(
        *KEYS, "item_id", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("share")).distinct()
    return reaching(by_shift, window, min_share).unionByName(short)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """The pairs of ``contaminated`` and ``copied``, each once with the larger share, in the columns of ``contaminated``."""
    met = matches(docs, benchmark, window, min_share)
    pairs = contaminated(met, window, min_share).unionByName(copied(met, window, min_share).withColumns(
        {"n_slots": F.lit(0), "reparameterised": F.lit(False)}))
    return (pairs.groupBy(*KEYS, "item_id")
            .agg(F.max(F.struct("share", "n_matched", "n_windows")).alias("best"), F.max("n_slots").alias("n_slots"),
                 F.max("reparameterised").alias("reparameterised"))
            .select(*KEYS, "item_id", "best.n_matched", "best.n_windows", "best.share", "n_slots", "reparameterised"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept; the texts themselves are not shuffled where the flags are few."""
    names = free_names(docs, "_id", "_hash")
    flagged = written(leaks(docs, benchmark).select("doc_id", "text_hash").distinct().toDF(*names), "flagged")
    match = docs["doc_id"].eqNullSafe(F.col(names[0])) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(names[1]))
    return docs.join(small(flagged, BROADCAST_FLAGGED), match, "left_anti")
