"""Tokenizers of a preparation: ids with the end id, an identity, a contract.

A tokenizer is anything with ``name``, ``fingerprint()``, ``ids(column)`` and ``count(column)``.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import text as tx

INT32 = (1 << 31) - 1


class Tokenizer(Protocol):
    name: str

    def fingerprint(self) -> str: ...

    def ids(self, text: Column) -> Column: ...

    def count(self, text: Column) -> Column: ...


class CodePoints:
    """The built-in tokenizer."""

    name = "codepoint-200"

    def fingerprint(self) -> str:
        return hashlib.sha256(self.name.encode()).hexdigest()

    def ids(self, text: Column) -> Column:
        return tx.codepoint_ids(text)

    def count(self, text: Column) -> Column:
        return tx.codepoint_count(text)


@cache
def _loaded(path: str):
    from tokenizers import Tokenizer as Loaded

    return Loaded.from_file(path)


def _whole(path: str) -> dict:
    return json.loads(_loaded(path).to_str())


@dataclass(frozen=True)
class FromFile:
    """A tokenizer of the public library's JSON format, loaded once per worker from a path that all share.

    The number of ids and the end id are a contract: another file is an error, as is an id that
    the sequences can't hold.  No special tokens are added but the end id, which always is.
    """

    path: str
    vocabulary: int
    end: int
    name: str = "file"

    def check(self) -> None:
        size = _loaded(self.path).get_vocab_size(with_added_tokens=True)
        if size != self.vocabulary or not 0 <= self.end < INT32:
            raise ValueError(f"the tokenizer has {size} ids, not {self.vocabulary}, or its end id is out of range")

    def fingerprint(self) -> str:
        """Digest of the whole definition, its ids in order, and the end id."""
        self.check()
        parts = {"definition": _whole(self.path), "vocabulary": sorted(_loaded(self.path).get_vocab(True).items()), "end": self.end}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def ids(self, text: Column) -> Column:
        path, end = self.path, self.end

        def encoded(texts: pd.Series) -> pd.Series:
            made = iter(_loaded(path).encode_batch(texts[texts.notna()].tolist(), add_special_tokens=False))
            ids = [None if t is None else [*next(made).ids, end] for t in texts]
            if any(not 0 <= i <= INT32 for row in ids if row for i in row):
                raise ValueError("an id is no 32-bit integer")
            return pd.Series(ids, texts.index, dtype=object)

        return F.pandas_udf(encoded, ArrayType(IntegerType())).asNondeterministic()(text)

    def count(self, text: Column) -> Column:
        return F.size(self.ids(text)).cast("bigint")

    def decode(self, ids: list[int]) -> str:
        """The text of one sequence; end ids are left out."""
        return _loaded(self.path).decode([i for i in ids if i != self.end], skip_special_tokens=False)
