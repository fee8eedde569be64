"""Operator 1, token counts: trie-shared dynamic programming.

A text's pre-tokens are its words.  The token count of a pre-token is the number
of pieces in its best segmentation under a unigram model (forward scores: the
best score of every prefix).  Prefixes are shared: the distinct pre-tokens of a
batch, sorted, are their trie in depth-first order; a stack holds the forward
scores along the current path, so the score of a shared prefix is computed once
and a word only pays for the letters after it.  Terminal counts are stored and
reused by later batches of the task.  The scan is one pass without a shuffle.

The public vocabulary files hold merge ranks instead of probabilities, so the
score of the piece at rank r is ``-log(r + 2)`` (Zipf's law).  A character that
no piece covers costs one token per UTF-8 byte at ``UNKNOWN`` each.  Equal scores:
fewer tokens win, then the longer last piece.

Defined cases: null or blank text has 0 tokens; very long words cost in
proportion to their length; an empty table gives an empty result; columns
besides id and text are neither read nor returned.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = -16.0
KNOWN = 400_000        # pre-tokens whose counts a task remembers


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> unigram score, from a sentencepiece file; control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): -math.log(i + 2) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class ForwardTrie:
    """Forward scores of pre-tokens, shared over common prefixes."""

    def __init__(self, pieces: dict[str, float], mark: str = MARK):
        self.pieces, self.mark = pieces, mark
        # every ending of a piece: a longer lookback is pointless once the text before is none of them
        self.tails = {p[i:] for p in pieces for i in range(len(p))}

    def counts(self, words: list[str]) -> list[int]:
        """Token counts of ``words``, which must be sorted and distinct."""
        pieces, tails = self.pieces, self.tails
        score, tokens = [0.0], [0]
        out, last = [], ""
        for w in words:
            w = self.mark + w
            same = len(os.path.commonprefix((last, w)))
            del score[same + 1:], tokens[same + 1:]
            for end in range(same + 1, len(w) + 1):
                c = w[end - 1]
                best, n = -math.inf, 0
                for at in range(end - 1, -1, -1):
                    piece = w[at:end]
                    if piece not in tails:
                        break
                    s = pieces.get(piece)
                    if s is not None:
                        s += score[at]
                        k = tokens[at] + 1
                        # the longer piece comes later and wins a full tie
                        if s > best or s == best and k <= n:
                            best, n = s, k
                if c not in pieces:
                    size = len(c.encode())
                    s = score[end - 1] + UNKNOWN * size
                    if s > best:
                        best, n = s, tokens[end - 1] + size
                score.append(best)
                tokens.append(n)
            out.append(tokens[-1])
            last = w
        return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: n_words, n_tokens."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(pieces.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [v.as_py().split() for v in part["raw"]]
                if len(known) > KNOWN:
                    known.clear()
                new = sorted((w.decode("utf-8", "replace"), w) for w in {w for ws in texts for w in ws} - known.keys())
                # equal strings can only come from broken bytes
                names = sorted({n for n, _ in new})
                by = dict(zip(names, trie.counts(names)))
                known.update((w, by[n]) for n, w in new)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(ws) for ws in texts], pa.int64()),
                     pa.array([sum(map(known.__getitem__, ws)) for ws in texts], pa.int64())],
                    names=["doc_id", "n_words", "n_tokens"])

    return (docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
            .mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long"))
