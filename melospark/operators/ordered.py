"""Ordered walks: state that restarts where the data decide, over each group's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Walk(Protocol):
    """One group's walk. Rows come in order, in one or several parts; what is certain is put out at once."""

    def feed(self, *columns: np.ndarray) -> list[tuple]: ...

    def finish(self) -> list[tuple]: ...


def ordered_walk(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Walk], names: list[str], schema: str
) -> DataFrame:
    """Runs a ``Walk`` over every group's ``columns`` (as doubles), rows sorted by ``order``. The result has the keys
    and ``names``, whose types are in ``schema``.

    Rows are dealt by the keys and sorted by Spark, which spills; a task passes through its batches and holds the
    state of one walk. So a group may be of any size, and keys are islands or runs where these spread a long take.
    """
    sort = [c for c in order if c not in columns]
    types = {f.name: f.dataType for f in df.schema}
    # A null key would turn a column of integers into doubles in pandas, so keys travel filled, with a flag.
    filled = [F.coalesce(k, F.lit("0").cast(types[k])).alias(k) for k in keys]
    flags = [f"no_{k}" for k in keys]
    laid = df.select(*filled, *(F.col(k).isNull().alias(f) for k, f in zip(keys, flags, strict=True)), *sort, *columns)
    laid = laid.repartition(*keys, *flags).sortWithinPartitions(*keys, *flags, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        walk: Walk | None = None
        out: list[tuple] = []

        def made() -> pd.DataFrame:
            columns = zip(*out, strict=True)
            frame = {n: pd.Series(c, dtype=object if n in keys and None in c else None) for n, c in zip([*keys, *names], columns, strict=True)}
            out.clear()
            return pd.DataFrame(frame)

        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), dtype=bool)
            for k in (*keys, *flags):
                values = pdf[k].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            new[0] = True
            starts = np.flatnonzero(new)
            key_rows = zip(*(pdf[k].iloc[starts].tolist() for k in keys), strict=True)
            absent = zip(*(pdf[f].iloc[starts].tolist() for f in flags), strict=True)
            arrays = [pdf[c].to_numpy(dtype=float) for c in columns]
            for key, gone, a, b in zip(key_rows, absent, starts, [*starts[1:], len(pdf)], strict=True):
                key = tuple(None if g else k for k, g in zip(key, gone, strict=True))
                if walk is None or key != held:
                    if walk is not None:
                        out.extend((*held, *row) for row in walk.finish())
                    held, walk = key, start()
                out.extend((*key, *row) for row in walk.feed(*(x[a:b] for x in arrays)))
            if out:
                yield made()
        if walk is not None:
            out.extend((*held, *row) for row in walk.finish())
            if out:
                yield made()

    return laid.mapInPandas(run, ", ".join([*(f"{k} {types[k].simpleString()}" for k in keys), schema]))
