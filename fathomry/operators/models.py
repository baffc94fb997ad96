"""The caller's models as functions of Columns: embedders, cross-encoders and generators for search, index and rerank alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a model gets at once.
ROWS_AT_ONCE = 32
#: The models that this worker has loaded, by name.
_loaded: dict[str, Callable] = {}


def hook(name: str, load: Callable[[], Callable[..., list]], kind: str, rows_at_once: int = ROWS_AT_ONCE) -> Callable[..., Column]:
    """A function of Columns that asks a model: ``load`` gives a callable of lists (one for each Column) that returns a list.

    A worker loads the model named ``name`` once, however many tasks it runs. Of each Arrow batch the model gets rows of
    similar length together, ``rows_at_once`` at most, so that little is padded. A row with a null input gets null and
    doesn't reach the model. ``kind`` is the result's type. ``load`` is sent to the workers, so it should read the model's
    files there.
    """

    @F.pandas_udf(kind)
    def ask(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        from fathomry.operators.models import _loaded  # the worker's own: what a sent function refers to is a copy

        if name not in _loaded:
            _loaded[name] = load()
        model = _loaded[name]
        for columns in batches:
            lists = [list(c) for c in (columns if isinstance(columns, tuple) else (columns,))]  # Spark passes one column alone
            given = [k for k in range(len(lists[0])) if not any(c[k] is None for c in lists)]
            given.sort(key=lambda k: sum(len(c[k]) if hasattr(c[k], "__len__") else 1 for c in lists))
            out = [None] * len(lists[0])
            for first in range(0, len(given), rows_at_once):
                at = given[first : first + rows_at_once]
                for k, found in zip(at, model(*([c[k] for k in at] for c in lists)), strict=True):
                    out[k] = found
            yield pd.Series(out, dtype=object)

    # The model may be costly: a plan must not ask it twice.
    return ask.asNondeterministic()
