"""Token counts of a unigram tokenizer by trie-shared dynamic programming.

A text's pre-tokens are its white-space words, each with the word mark in front.
The best segmentation of a pre-token has the greatest sum of piece scores;
among equal sums, the fewest tokens.  Its forward scores at a position depend on
the characters before it only, so the distinct pre-tokens of a block are walked
as a trie, in order: a node's forward score is computed once for all pre-tokens
that share the prefix, and each terminal stores its token count.  Documents then
sum the counts of their words.

The vocabulary is that of a public tokenizer file, read for its pieces alone;
scores are ``-log(rank + 2)`` by the pieces' order in the file, since no file of a unigram
tokenizer with scores is at hand; ``Counter`` takes any pieces with scores.  A character
outside all pieces falls back to one token per UTF-8 byte, at ``BYTE_SCORE`` each.

Counting is one map, without a shuffle.  Counts of up to ``CACHE_WORDS`` distinct
words are kept per worker; beyond that the cache starts anew.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _text as T
from palimpsest.session import share_seed

MARK = "▁"
BYTE_SCORE = -20.0
CACHE_WORDS = 1_000_000
BATCH_WORDS = 50_000


class Counter:
    """Token counts of words, by the trie walk."""

    _held: dict[str, Counter] = {}

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._held:
            cls._held[path] = cls(vocabulary(path))
        return cls._held[path]

    def forget(self) -> None:
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def terminals(self, words: list[str]) -> list[int]:
        """Token count of each of the sorted distinct words."""
        pieces, longest = self.pieces, self.longest
        best, used, out, last = [0.0], [0], [], ""
        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del best[same + 1 :], used[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, count = best[end - 1] + n * BYTE_SCORE, used[end - 1] + n
                for begin in range(max(0, end - longest), end):
                    score = pieces.get(word[begin:end])
                    if score is not None:
                        score += best[begin]
                        if score > top or (score == top and used[begin] < count):
                            top, count = score, used[begin] + 1
                best.append(top)
                used.append(count)
            out.append(used[len(word)])
            last = word
        return out

    def block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) per document."""
        w = T.Words(buf, offs)
        raw = buf.tobytes()
        distinct, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        new = np.flatnonzero(~T.in_sorted(distinct, self.hash))
        if len(self.hash) + len(new) > CACHE_WORDS:
            self.forget()
            new = np.arange(len(distinct))
        for lo in range(0, len(new), BATCH_WORDS):
            part = new[lo : lo + BATCH_WORDS]
            words = [MARK + raw[w.start[k] : w.end[k]].decode("utf-8", "replace") for k in first[part].tolist()]
            order = sorted(range(len(words)), key=words.__getitem__)
            count = np.zeros(len(words), np.int64)
            count[order] = self.terminals([words[k] for k in order])
            every = np.concatenate([self.hash, distinct[part]])
            rank = np.argsort(every)
            self.hash, self.count = every[rank], np.concatenate([self.count, count])[rank]
        total = np.zeros(len(w.start) + 1, np.int64)
        if len(w.start):
            np.cumsum(self.count[np.searchsorted(self.hash, distinct)][back], out=total[1:])
        return np.diff(w.offs), total[w.offs[1:]] - total[w.offs[:-1]]


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model file with scores by rank; control and byte pieces left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return {m.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(ids)}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens, n_bytes.

    Null and empty texts have 0 of each; ids are passed on as they are, so repeated
    rows give a row each; texts of any length are counted whole; an empty table
    gives an empty result; of segmentations with equal sums the fewest tokens
    count; other columns are ignored.  ``model_path`` must exist on every worker.
    """

    share_seed(docs.sparkSession)

    def run(batches):
        counter = Counter.of(model_path)
        for batch in batches:
            for lo, hi, buf, offs in T.blocks(None, batch.column(1)):
                n, tokens = counter.block(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.diff(offs), pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts of all `documents`."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
