"""Batches of files in slices, so that what a Python worker holds of results does not grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pandas as pd

SIZE = 200


def slices(batch: pd.DataFrame, size: int = SIZE) -> Iterator[tuple[pd.DataFrame, Callable]]:
    """Slices of a batch, each with once(key, f): f(key), computed once for equal keys of the slice."""
    for at in range(0, len(batch), size):
        seen: dict[Hashable, object] = {}

        def once(key: Hashable, f: Callable, seen: dict = seen) -> object:
            if key not in seen:
                seen[key] = f(key)
            return seen[key]

        yield batch.iloc[at : at + size], once
