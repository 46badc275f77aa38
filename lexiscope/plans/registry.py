"""One model registry shared by the embedding job and the evaluation job.

A model = a tokenizer (text column -> tokens) + a vectorizer. Without one of
its own it has hashed n-gram counts of width ``dim``, idf-weighted and
L2-normalised, which are columns, so all such models share a pass over the
corpus. A ``Vectorizer`` of its own is fitted on the tokens of the corpus and
adds the vectors to a DataFrame: trained word vectors, or a model of the user's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame

from ..functions.text import truncate_tokens
from ..functions.tokens import BYTE_VOCAB_SIZE, CHAR_VOCAB_SIZE, byte_tokens, char_tokens


@dataclass(frozen=True)
class Tokenizer:
    name: str
    vocab_size: int
    column_fn: Callable[[Column], Column]
    max_length: int | None = None
    end_marks: int = 0  # special tokens behind the text, kept by truncation

    def tokens(self, text: Column) -> Column:
        t = self.column_fn(text)
        return truncate_tokens(t, self.max_length, self.end_marks) if self.max_length else t


class Vectorizer(Protocol):
    """``fit`` gets rows with ``text`` and ``tokens`` and returns a state;
    ``transform`` adds ``embedding`` of width ``dim`` to such rows."""

    dim: int

    def fit(self, docs: DataFrame) -> Any: ...

    def transform(self, docs: DataFrame, state: Any) -> DataFrame: ...


@dataclass(frozen=True)
class WordVectors:
    """Mean of word vectors trained on the corpus; tokens are words."""

    dim: int = 64
    min_count: int = 5
    max_iter: int = 5
    seed: int = 42

    def fit(self, docs: DataFrame) -> Any:
        from ..operators.vectorize import fit_word2vec

        return fit_word2vec(docs, "tokens", self.dim, self.min_count, self.seed, self.max_iter)

    def transform(self, docs: DataFrame, state: Any) -> DataFrame:
        from ..operators.vectorize import embed_word2vec

        return embed_word2vec(state, docs)


@dataclass(frozen=True)
class SkipGram:
    """Mean of word vectors from the sharded trainer; the state is their table."""

    dim: int = 64
    min_count: int = 5
    rounds: int = 6
    seed: int = 42

    def fit(self, docs: DataFrame) -> Any:
        from ..operators.skipgram import train_vectors

        return train_vectors(docs, "tokens", self.dim, min_count=self.min_count, rounds=self.rounds, seed=self.seed)

    def transform(self, docs: DataFrame, state: Any) -> DataFrame:
        from ..operators.skipgram import mean_vectors

        return mean_vectors(docs, state, "tokens")


@dataclass(frozen=True)
class External:
    """A user's own text encoder: ``make_predict_fn()`` gives a function of an
    array of texts."""

    make_predict_fn: Callable
    dim: int
    batch_size: int = 64

    def fit(self, docs: DataFrame) -> None:
        return None

    def transform(self, docs: DataFrame, state: Any) -> DataFrame:
        from ..operators.vectorize import embed_external

        return embed_external(docs, "text", self.make_predict_fn, self.dim, self.batch_size)


@dataclass(frozen=True)
class Model:
    name: str
    tokenizer: Tokenizer
    dim: int = 256
    ngram: int = 2
    use_idf: bool = True
    vectorizer: Vectorizer | None = field(default=None, hash=False, compare=False)
    options: dict = field(default_factory=dict, hash=False, compare=False)


# Token limits of the reference's embedders: 512 for byte / subword models and
# 2048 for the character model. Off by default here (whole texts); set
# ``max_length`` to reproduce the truncation.
BYTE = Tokenizer("byte", BYTE_VOCAB_SIZE, lambda c: byte_tokens(c), end_marks=1)
CHAR = Tokenizer("char", CHAR_VOCAB_SIZE, lambda c: char_tokens(c), end_marks=1)

def _words(text: Column) -> Column:
    from ..operators.wordpiece import basic_words

    return basic_words(text)


WORDS = Tokenizer("words", 0, _words)

MODELS: dict[str, Model] = {
    "byte-hashed": Model("byte-hashed", BYTE),
    "char-hashed": Model("char-hashed", CHAR),
    "word2vec": Model("word2vec", WORDS, dim=64, vectorizer=WordVectors(64)),
}


def wordpiece_model(vocab: list[str], name: str = "wordpiece-hashed") -> Model:
    """Word pieces of a built vocabulary under the hashed vectorizer."""
    from ..operators.wordpiece import wordpiece_tokens

    return Model(name, Tokenizer("wordpiece", len(vocab), lambda c: wordpiece_tokens(c, vocab), end_marks=1))


def bpe_model(merges: dict[tuple[int, int], int], name: str = "bpe-hashed") -> Model:
    """A merge table's greedy encoding under the hashed vectorizer."""
    return Model(name, bpe_tokenizer("bpe", merges, 256 + len(merges)))


def skipgram_model(dim: int = 64, name: str = "skipgram", **options) -> Model:
    """Word vectors whose table never meets the driver."""
    return Model(name, WORDS, dim=dim, vectorizer=SkipGram(dim, **options))


def external_model(name: str, make_predict_fn: Callable, dim: int) -> Model:
    """A user's own text encoder."""
    return Model(name, WORDS, dim=dim, vectorizer=External(make_predict_fn, dim))


def bpe_tokenizer(name: str, merges: dict[tuple[int, int], int], vocab_size: int) -> Tokenizer:
    from ..operators.bpe import bpe_encode_col

    return Tokenizer(name, vocab_size, lambda c: bpe_encode_col(c, merges))


def choose(names: str | list[str] = "all", skip: list[str] | None = None,
           extra: dict[str, Model] | None = None) -> list[Model]:
    """``all``, a list of names, minus ``skip``."""
    pool = dict(MODELS)
    pool.update(extra or {})
    chosen = list(pool) if names == "all" else list(names)
    unknown = [n for n in chosen if n not in pool]
    if unknown:
        raise KeyError(f"unknown models: {unknown}")
    return [pool[n] for n in chosen if n not in set(skip or [])]
