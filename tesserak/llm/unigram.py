"""Token counts of a unigram tokenizer, without building its tokens.

Aho-Corasick lists every vocabulary piece that ends at each place of a word; a
dynamic program carries the best score to each place together with the number of
pieces on that path.  Ties keep the path found first, the one whose last piece
begins earliest, as the tokenizer does.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value of the tokenizer: how far an unknown character is below the worst piece.
UNKNOWN_PENALTY = 10.0
#: What stands before each word.
MARK = "▁"


def sentencepiece_vocabulary(path: str, shift: float = 2.7) -> list[tuple[str, float]]:
    """(piece, log probability) of a sentencepiece file's ordinary pieces, ``<unk>`` first.

    No unigram file ships with the public tokenizers and none is trained here: the
    file is a BPE model, whose scores are minus the merge rank and no logarithms.
    A piece of rank r therefore gets the probability that the law of Zipf and
    Mandelbrot gives it, in proportion to 1 / (r + ``shift``).  Pieces without a
    rank, which stand for runs of spaces, are left out.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    ranked = [(sp.id_to_piece(i), -sp.get_score(i)) for i in ids if sp.get_score(i) > -1e8]
    total = math.log(sum(1 / (r + shift) for _, r in ranked))
    return [("<unk>", 0.0), *((piece, -math.log(r + shift) - total) for piece, r in ranked)]


class PieceCounter:
    """``count(word)``: pieces of the best path through a word.

    Only the last places, as many as the longest piece has characters, are kept.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.found = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.kept = 1 + max((len(p) for p, _ in vocabulary[1:]), default=1)

    def count(self, word: str) -> int:
        kept = self.kept
        best, pieces, unknown = [0.0] * kept, [0] * kept, [False] * kept  # by place modulo ``kept``
        matches = self.found.iter(word) if len(self.found) else iter(())
        match = next(matches, None)
        for end in range(len(word)):
            here = []
            while match is not None and match[0] == end:
                here.append(match[1])
                match = next(matches, None)
            if len(here) > 1:
                here.sort(reverse=True)  # longest first: begins earliest
            top, single, lone, last = None, False, False, end % kept
            for size, score in here:
                single |= size == 1
                at = (end + 1 - size) % kept
                if top is None or best[at] + score > top:
                    top, count = best[at] + score, pieces[at] + 1
            if not single and (top is None or best[last] + self.unknown > top):
                top, lone = best[last] + self.unknown, True
                count = pieces[last] + (not unknown[last])  # unknown characters in a row are one token
            at = (end + 1) % kept
            best[at], pieces[at], unknown[at] = top, count, lone
        return pieces[len(word) % kept]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], most_words: int = 300_000) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row (doc_id, text).

    Words are runs of characters that aren't white space, each with the mark
    before it; pieces never cross words.  Counts of distinct words are kept per
    task, at most ``most_words`` of them, none of over 1,000 characters.  A null or
    empty text has 0 of both; repeated rows and null ids stay as they are; other
    columns are dropped, whatever their names; no rows: none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter, known = PieceCounter(shared.value), {}
        for b in batches:
            words_out, tokens_out = [], []
            for text in b.column("text").to_pylist():
                words = Counter((text or "").split())
                tokens = 0
                for w, times in words.items():
                    if (n := known.get(w)) is None:
                        n = counter.count(MARK + w)
                        if len(w) <= 1000:
                            if len(known) >= most_words:
                                known.clear()
                            known[w] = n
                    tokens += n * times
                words_out.append(words.total())
                tokens_out.append(tokens)
            yield pa.record_batch([b.column("doc_id"), pa.array(np.array(words_out, dtype=np.int64)), pa.array(np.array(tokens_out, dtype=np.int64))], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
