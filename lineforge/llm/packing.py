"""Packing: documents' tokens concatenated and cut into fixed windows.

Pass one tokenises every document and writes ids with the partition that held
it; the partitions' token totals are summed in two levels of prefix sums,
which gives every document a global offset.  Pass two cuts each document at
the window boundaries that it crosses; a piece that ends or begins at a cut
carries a boundary mark.  Every id lies in one piece, and only the very last
window can have padding.

A null text is empty: its document is the end id alone.  Repeated rows are
packed each on its own; an empty table has no pieces; very long documents
span many windows.  Extra columns never reach the worker.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, no_nulls, pieces, small, to_arrow, trim_memory, written

WINDOW = 4096
END_ID = 2
#: Words whose ids a worker remembers in each of two generations, about 160 bytes each, as long as it lives.
MEMORY = 450_000
#: Characters that are cut into words at once.
STRETCH = 1 << 18
#: Letters beyond ASCII whose lower case is one letter and that normal form C leaves alone (U+00C0 to U+017F without signs and U+0130).
LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130))
OTHER = re.compile(rf"[^ -~\n{LATIN}]|<\|")
BREAK = re.compile(r"[ \n]")
#: Partitions whose totals are summed in one group; the groups' totals are summed over all groups.
BLOCK = 1024
#: At most so many partition offsets (two numbers each) are broadcast.
BROADCAST_PARTITIONS = 1_000_000


#: Packers of so many ids as little-endian unsigned 32-bit numbers.
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class Parts(dict):
    """Ids of word parts as bytes; a part not met since the memory last filled up is tokenised anew."""

    def __init__(self, tokenize, level: dict[int, str], older: dict[str, bytes]) -> None:
        super().__init__()
        self.tokenize, self.level, self.older = tokenize, level, older

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            tokens = self.tokenize(part if part.isascii() else part.translate(self.level))
            n = len(tokens)
            ids = (PACK[n] if n < len(PACK) else struct.Struct(f"<{n}I").pack)(*[t.id for t in tokens])
        self[part] = ids
        return ids


class WordIds:
    """Ids of texts by a tokenizer whose tokens never cross white space, with words remembered.

    Where the vocabulary file says how a word is cut (lower case, then one
    expression), runs of blanks, line feeds, printable ASCII and ``LATIN``
    letters are cut here, so that "The", "the" and "the," share one model
    call.  A word with any other character goes to the tokenizer whole, as
    one chunk between blanks and line feeds.
    """

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.memory = memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = latin_cut(*(json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in LATIN}
        self.parts = Parts(self.tokenizer.model.tokenize, self.level, {})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if len(self.parts) > self.memory:
            self.parts = Parts(self.parts.tokenize, self.level, dict(self.parts))
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        if not self.cut:
            return b"".join(self.whole(text.replace("\n", " ").split(" ")))
        places = list(other_chunks(text))
        strange = self.whole([text[a:b] for a, b in places])
        out, at = [], 0
        for (a, b), ids in zip(places, strange):
            out += self.plain(text, at, a)
            out.append(ids)
            at = b
        out += self.plain(text, at, len(text))
        return b"".join(out)

    def plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        """Ids of a stretch without other characters, some hundred thousand characters at a time."""
        while start < end:
            cut = end if end - start <= STRETCH else text.find(" ", start + STRETCH, end) + 1 or end
            yield b"".join(map(self.parts.__getitem__, self.cut.findall(text[start:cut].lower())))
            start = cut

    def whole(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by the tokenizer itself, equal chunks once."""
        known, new = self.known, []
        for c in set(chunks):
            if c not in known:
                ids = self.older.get(c)
                if ids is None:
                    new.append(c)
                else:
                    known[c] = ids
        for at in range(0, len(new), 1024):
            part = new[at:at + 1024]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[c] = np.array(e.ids, "<u4").tobytes()
        return [known[c] for c in chunks]


def other_chunks(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the chunks between blanks and line feeds that hold any other character, or a special token's start."""
    at = 0
    for m in OTHER.finditer(text):
        if m.start() < at:
            continue
        start = max(text.rfind(" ", at, m.start()), text.rfind("\n", at, m.start())) + 1 or at
        end = BREAK.search(text, m.end())
        at = end.start() if end else len(text)
        yield start, at


@lru_cache(maxsize=2)
def word_ids(path: str, memory: int) -> WordIds:
    """One per Python worker: its memory serves all tasks that the worker runs."""
    return WordIds(path, memory)


def latin_cut(normalizer: dict, pre_tokenizer: dict) -> re.Pattern | None:
    """The expression that cuts lower-case words, if the vocabulary file has NFC, lower case and one expression alone."""
    normal = [n["type"] for n in normalizer.get("normalizers", [])]
    steps = pre_tokenizer.get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, level = steps
    if not (split.get("invert") and split["behavior"] == "Removed" and "Regex" in split["pattern"]) or level["use_regex"] or level["add_prefix_space"]:
        return None
    letters = "a-z" + "".join(sorted(set(LATIN.lower())))
    shape = (split["pattern"]["Regex"].replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", "[0-9]")
             .replace(r"\p{L}", letters).replace(r"\p{N}", "0-9"))
    return None if r"\p" in shape else re.compile(shape)


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, memory: int = MEMORY) -> DataFrame:
    """part, doc_id, before (ids before it in its part), n_ids, ids (little-endian 32 bit); written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"part long, doc_id {kind}, before long, n_ids long, ids binary")
    arrow, end = to_arrow(schema), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        ids_of, part, before = word_ids(path, memory), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), pieces(batch.column(1))):
                ids = ids_of.of(no_nulls(text)) + end
                rows.append((part, doc_id, before, len(ids) // 4, ids))
                before, size = before + len(ids) // 4, size + len(ids)
                if size > 4 << 20 or len(rows) >= 4096:
                    yield as_batch(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield as_batch(rows, arrow)

    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """part and base, the ids in all parts before it: sums per part, within blocks of parts, then over blocks."""
    totals = (tokens.groupBy("part").agg(F.sum("n_ids").alias("total"))
              .withColumn("block", F.expr(f"part div {BLOCK}")))
    within = totals.withColumn("in_block", F.sum("total").over(
        Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    blocks = (totals.groupBy("block").agg(F.sum("total").alias("total"))
              .withColumn("before_block", F.sum("total").over(  # one row for each BLOCK partitions
                  Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
              .select("block", "before_block"))
    return within.join(blocks, "block").selectExpr(
        "part", "coalesce(in_block, 0) + coalesce(before_block, 0) AS base")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, memory: int = MEMORY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, cut_before, cut_after.

    ``path`` is a vocabulary file in the tokenizers format, readable on every
    executor; ``memory`` words are remembered, which changes no result.
    """
    tokens = tokenised(docs, path, end_id, memory)
    placed = tokens.join(small(offsets(tokens), BROADCAST_PARTITIONS), "part").withColumn("at", F.expr("base + before"))
    first, last = f"(at div {window})", f"((at + n_ids - 1) div {window})"
    return (placed.selectExpr("doc_id", "n_ids AS doc_tokens", "at", "ids", f"""inline(transform(sequence({first}, {last}), s -> named_struct(
                'sequence_id', s,
                'start', greatest(s * {window} - at, 0L),
                'length', least((s + 1) * {window}, at + n_ids) - greatest(s * {window}, at),
                'ids', substring(ids, CAST(4 * greatest(s * {window} - at, 0L) + 1 AS INT),
                                 CAST(4 * (least((s + 1) * {window}, at + n_ids) - greatest(s * {window}, at)) AS INT)))))
            AS (sequence_id, start, length, piece)""")
            .selectExpr("doc_id", "start", "length", "piece AS ids", "doc_tokens", "sequence_id",
                        f"at + start - sequence_id * {window} AS offset",
                        "start > 0 AS cut_before", "start + length < doc_tokens AS cut_after"))
