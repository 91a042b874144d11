"""Arrow-batched functions that are made when they are first applied, so that modules load without a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def put(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def apply(*columns: Column | str) -> Column:
            return F.pandas_udf(function, returns)(*columns)

        return apply

    return put


#: Characters of text whose results a task holds before it hands them on.
PART = 1 << 20


def in_parts(batches: Iterator[pd.Series], most: int = PART) -> Iterator[pd.Series]:
    """Batches of texts in parts of about ``most`` characters, one text at least: what is made of a part is handed on before
    the next one is looked at, however many rows a batch has."""
    for batch in batches:
        low, size = 0, 0
        for high, t in enumerate(batch, 1):
            size += 1 if t is None else len(t)
            if size >= most:
                yield batch.iloc[low:high]
                low, size = high, 0
        if low < len(batch):
            yield batch.iloc[low:]


class Memo(dict):
    """What ``make`` gave for a key; forgotten when there are ``most`` of them. Travels empty."""

    def __init__(self, make: Callable, most: int = 1 << 17):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        made = self[key] = self.make(key)
        return made

    def __reduce__(self):
        return Memo, (self.make, self.most)
