"""Quality rules: text statistics, and an ordered rule list learned from labelled ones.

``document_stats`` measures every whole text.  ``learn_rules`` grows and
prunes threshold conjunctions by sequential covering on labelled statistics;
``verdict`` emits the list as one ordered Spark conditional expression.

A null text has no words, as an empty one, and fails the base rule.  Repeated
rows are measured each on its own; ties between candidate thresholds go to
the first feature in ``FEATURES`` and the lower threshold; without labelled
rows of both classes the list is empty and keeps what passes the base rule.
Long texts are measured whole, in memory in proportion to one text.  An empty
table gives no rows; extra columns never reach the worker.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, map_rows, no_nulls, training_labels

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_distinct", "n_same", "n_upper", "n_marks", "n_bare")
#: What rules compare with thresholds, as Spark SQL over the statistics.
FEATURES = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "same_as_previous": "n_same / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "bare_words": "n_bare / greatest(n_words, 1)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "words": "CAST(n_words AS DOUBLE)",
}
#: At most so many labelled rows are fitted, those with the smallest hash of doc_id.
MAX_ROWS = 20_000
#: Cut points tried per feature; conditions per rule; rules; precision that a rule needs on the pruning rows.
CUTS, MAX_CONDITIONS, MAX_RULES, MIN_PRECISION = 48, 4, 12, 0.9
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
HAS_ALNUM = re.compile(rb"[0-9A-Za-z\x80-\xff]")


class Condition(NamedTuple):
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float


Rule = list[Condition]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions inside windows of ``window`` (a power of two) ids that occur twice or more.

    Windows are ranked exactly by doubling: equal pairs of equal halves.
    """
    rank, width = ids, 1
    while width < window:
        if len(rank) <= width:
            return 0
        pair = rank[:-width] * np.int64(len(ids) + 1) + rank[width:]
        _, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        width *= 2
    twice = counts[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The values of ``STATS`` for one whole text."""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = np.bincount(ids, minlength=len(seen))
    raw = np.frombuffer(data, np.uint8)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in ASCII_SPACE),
        sum(data.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(seen),
        int((ids[1:] == ids[:-1]).sum()),
        int(((raw >= 65) & (raw <= 90)).sum()),
        data.count(b"!") + data.count(b"?"),
        int(sum(counts[i] for w, i in seen.items() if not HAS_ALNUM.search(w))),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATS`` of every row; one pass over the texts, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, " + ", ".join(f"{s} long" for s in STATS),
                    lambda doc_id, text: iter([(doc_id, *text_stats(no_nulls(text)))]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of at most ``max_rows`` labelled documents outside the held-out fold.

    Rows that fail the base rule are left out: the list judges only the others.
    Statistics are a few numbers a row, so the bound holds for bytes too.
    """
    rows = (stats.where(~base_failed()).join(F.broadcast(training_labels(labels, max_rows)), "doc_id")
            .selectExpr("doc_id", "quality", *(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in FEATURES.items()))
            .groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("x")).select("doc_id", "x.*").collect())  # one row a doc_id
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    x = np.array([[r[name] for name in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return x, np.array([r.quality for r in rows], int)


def fit_rules(x: np.ndarray, quality: np.ndarray) -> list[Rule]:
    """Sequential covering: each rule rejects; rows that it covers leave before the next one grows.

    Two rows in three grow a rule by information gain, the third prunes it
    from its end for precision.  A rule below ``MIN_PRECISION`` on the pruning
    rows ends the list.
    """
    bad = quality == 0
    names, rules = list(FEATURES), []
    part = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & ~part & bad).sum() >= 3 and (left & ~bad).any():
        rule = pruned(grown(x, bad, left & ~part), x, bad, left & part)
        hit = covers(rule, x) & left
        check = hit & part if (hit & part).sum() >= 3 else hit
        if not rule or not hit.any() or bad[check].mean() < MIN_PRECISION:
            break
        rules.append([Condition(names[f], above, cut) for f, above, cut in rule])
        left &= ~hit
    return rules


def covers(rule: list[tuple], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, cut in rule:
        hit &= (x[:, f] > cut) == above
    return hit


def grown(x: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """Add the condition of the highest gain until no good row is covered."""
    rule, hit = [], rows.copy()
    while (hit & ~bad).any() and len(rule) < MAX_CONDITIONS:
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = np.unique(x[hit, f])
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > CUTS:
                near = np.unique(x[hit & bad, f])  # edges of the class to reject, and even quantiles
                cuts = np.unique(np.concatenate([cuts[np.linspace(0, len(cuts) - 1, CUTS).astype(int)],
                                                 np.quantile(near, np.linspace(0, 1, CUTS)) - 1e-9]))
            for cut in cuts:
                for above in (True, False):
                    new = hit & ((x[:, f] > cut) == above)
                    p1, n1 = (new & bad).sum(), (new & ~bad).sum()
                    if p1 and (value := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > gain:
                        best, gain = (f, above, float(cut)), value
        if best is None:
            break
        rule.append(best)
        hit &= (x[:, best[0]] > best[2]) == best[1]
    return rule


def pruned(rule: list[tuple], x: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """The shortest start of the rule with the best (p - n) / (p + n) on the pruning rows."""
    def worth(length: int) -> float:
        hit = covers(rule[:length], x) & rows
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn_rules(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    return fit_rules(*labelled(stats, labels, max_rows))


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the first rule that holds rejects, else the text stays."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        test = F.lit(True)
        for feature, above, cut in rule:
            value = F.expr(FEATURES[feature])
            test &= value > F.lit(cut) if above else value <= F.lit(cut)
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))
