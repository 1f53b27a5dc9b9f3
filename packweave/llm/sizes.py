"""Token counts of texts under an existing tokenizer, as a column. Tokenizers are given, never trained."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import model_rows
from .linmax import LinMaxTrie, TokenCounter, pieces_of

TOKENIZER_DIR = "/opt/tokenizers"


def vocab_pieces(vocab: DataFrame) -> dict[str, int]:
    """The pieces of a vocabulary table, a model whose bytes are checked."""
    return pieces_of(model_rows(vocab.select("token_id", "piece").where("token_id is not null and piece is not null"), "the vocabulary"))


def vocab_counter(spark: SparkSession, vocab: DataFrame):
    """A function Column -> Column that counts the ids of a text under ``vocab`` by longest match."""
    shared = spark.sparkContext.broadcast(vocab_pieces(vocab))
    held: list[TokenCounter] = []

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        if not held:
            held.append(TokenCounter(LinMaxTrie(shared.value)))
        one = held[0]
        return pd.Series([None if t is None else one(t) if t else 0 for t in text], dtype="Int64")

    return count.asNondeterministic()  # else a filter on the counts would count every text twice


class SegmentSizes(dict):
    """Counts by segment for a tokenizer whose pieces hold the space mark only at their front.

    No piece then spans the front of a word, so a text's ids are those of its words, one after the other.
    """

    def __init__(self, encode, limit: int = 200_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n


def segment_sum(text: str, sizes: dict) -> int:
    """Sum of the counts of the runs of spaces plus word that make up ``text``; ``sizes`` puts one mark before each."""
    words = text.split(" ")
    if "" not in words:
        return sum(map(sizes.__getitem__, words))
    n, pending = 0, ""
    for w in words:
        if w:
            n += sizes[pending + w]
            pending = ""
        else:
            pending += " "
    if pending:
        n += sizes[pending[1:]] if len(pending) > 1 else 1
    return n


def public_counter(spark: SparkSession, path: str | None = None):
    """A function Column -> Column that counts the ids of a text under a public sentencepiece model file.

    If no piece holds the space mark behind another character, counts are added up over cached words, which is
    exact; otherwise the model reads each whole text. Null text: null; empty text: 0.
    """
    where = path or os.path.join(TOKENIZER_DIR, "piece_bpe_32k.model")
    held: list = []

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        if not held:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=where)
            divided = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            held.append((model, SegmentSizes(model.encode) if divided else None))
        model, sizes = held[0]
        out = []
        for t in text:
            if not t:
                out.append(None if t is None else 0)
            else:
                out.append(len(model.encode(t)) if sizes is None else segment_sum(t, sizes))
        return pd.Series(out, dtype="Int64")

    return count.asNondeterministic()  # else a filter on the counts would count every text twice
