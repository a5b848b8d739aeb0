"""Text encoders: what turns a batch of texts into vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], "numpy.ndarray"]  # noqa: F821

DIMENSION = 64
_PLACES_KEPT = 1_000_000


@dataclass(frozen=True)
class HashingEncoder:
    """An encoder that needs no model: counted words, hashed into places, at unit length.

    Called, it gives the function that encodes a batch; a model-backed encoder is a
    factory of the same kind, called once per Python worker. Unlike those, its counts add
    up over the parts of a text.
    """

    dimension: int = DIMENSION

    def __call__(self) -> Encoder:
        import numpy as np

        count = self.counter()

        def encode(texts: Sequence[str]) -> np.ndarray:
            out = count(texts)
            length = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, length, out=np.zeros_like(out), where=length > 0)

        return encode

    def counter(self) -> Encoder:
        """The function that counts the words of a batch by place. Each distinct word is hashed once."""
        import hashlib
        import re

        import numpy as np

        word = re.compile(r"[^ \t\r\n\f\v]+")
        places: dict[str, int] = {}
        dimension = self.dimension

        def count(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for i, text in enumerate(texts):
                found = Counter(word.findall((text or "").lower()))
                if len(places) > _PLACES_KEPT:
                    places.clear()
                for token in [t for t in found if t not in places]:
                    places[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimension
                if found:
                    at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
                    out[i] = np.bincount(at, weights=np.fromiter(found.values(), float, len(found)), minlength=dimension)
            return out

        return count

    def add_counts(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add ``out``: how many words of the text fall in each place."""

        @F.pandas_udf("array<double>")
        def to_counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            count = self.counter()
            for batch in batches:
                yield pd.Series(list(count(batch.tolist())))

        return df.withColumn(out, to_counts(F.col(text)))


def with_unit_vector(df: DataFrame, counts: str, out: str) -> DataFrame:
    """Replace a column of counts by ``out``, the vector of unit length; all zeros stay as they are."""
    kept = [c for c in df.columns if c != counts]
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * n))
    unit = F.transform(counts, lambda n: F.when(norm > 0, n / norm).otherwise(F.lit(0.0)).cast("float"))
    return df.select(*kept, unit.alias(out))


def hashing_encoder(dimension: int = DIMENSION) -> HashingEncoder:
    """The encoder that needs no model."""
    return HashingEncoder(dimension)
