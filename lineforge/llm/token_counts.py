"""Token counts by a unigram model, with a trie that shares the work of common prefixes.

A text's pre-tokens are its words, each with the word-start mark before it.
The distinct ones are inserted in a trie; the best (forward) score of a prefix
is computed once, when its node is made, from the scores of shorter prefixes
on the same path and the pieces that end there.  The node of a whole
pre-token then has the token count of its best segmentation.

Pieces come from a public vocabulary file; their log probabilities follow
Zipf's law over the file's order, as the file has ranks and no probabilities.
A character without a piece falls back to one token for each of its UTF-8
bytes.  Ties between equal scores go to fewer tokens.

A null text counts as an empty one (no tokens); repeated rows are counted each
on its own; long texts and long words are counted whole, in time linear in
their length.  Each worker's trie is started anew past ``MAX_NODES`` nodes,
which changes no result.  Extra columns never reach the worker; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import map_rows, no_nulls

MARK = "▁"
#: Zipf's shift, and what a byte of an unknown character costs beyond the rarest piece.
SHIFT, BYTE_COST = 2.7, 10.0
MAX_NODES = 300_000


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with their log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (n + SHIFT) for n in range(len(pieces))))
    return {p: -math.log(n + SHIFT) - total for n, p in enumerate(pieces)}


class Trie:
    """Prefixes of pre-tokens, each with its best score, token count and byte tokens."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.byte = min(pieces.values()) - BYTE_COST
        self.ends: dict = {}  # pieces by their characters from the last to the first
        for piece, score in pieces.items():
            at = self.ends
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = score
        self.start()

    def start(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.parent, self.char = [0], [""]
        self.score, self.count, self.bytes = [0.0], [0], [0]
        self.known: dict[str, int] = {}

    def node(self, word: str) -> int:
        """The node of ``MARK + word``; missing nodes on its path are made and scored."""
        at = self.known.get(word)
        if at is None:
            if len(self.char) > MAX_NODES:
                self.start()
            at = 0
            for c in MARK + word:
                down = self.child[at].get(c)
                at = self.extend(at, c) if down is None else down
            self.known[word] = at
        return at

    def extend(self, parent: int, c: str) -> int:
        width = len(c.encode())
        best = (self.score[parent] + width * self.byte, -self.count[parent] - width, self.bytes[parent] + width)
        piece, before = self.ends.get(c), parent
        while piece is not None:
            if "" in piece:
                found = (self.score[before] + piece[""], -self.count[before] - 1, self.bytes[before])
                if found[:2] > best[:2]:
                    best = found
            if before == 0:
                break
            piece, before = piece.get(self.char[before]), self.parent[before]
        new = len(self.char)
        self.child.append({})
        self.child[parent][c] = new
        self.parent.append(parent)
        self.char.append(c)
        self.score.append(best[0])
        self.count.append(-best[1])
        self.bytes.append(best[2])
        return new


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_byte_tokens and log_prob of every row, without a shuffle.

    ``path`` is a sentencepiece file that every executor can read.
    """
    state: dict[str, Trie] = {}

    def rows(doc_id, text):
        trie = state.get(path) or state.setdefault(path, Trie(vocabulary(path)))
        words = no_nulls(text).encode().split()
        tokens = from_bytes = 0
        log_prob = 0.0
        for word in words:
            at = trie.node(word.decode())
            tokens += trie.count[at]
            from_bytes += trie.bytes[at]
            log_prob += trie.score[at]
        yield doc_id, len(words), tokens, from_bytes, log_prob

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, n_words long, n_tokens long, n_byte_tokens long, log_prob double", rows)
