"""JSON of unknown shape: the two places where built-in functions can't keep order and nesting, done over Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(x) -> list[str]:
    if isinstance(x, str):
        return [x]
    if isinstance(x, dict):
        return [s for v in x.values() for s in _leaves(v)]
    if isinstance(x, list):
        return [s for v in x for s in _leaves(v)]
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaves(text: pd.Series) -> pd.Series:
    """String values of a JSON text at any depth, in order; keys, numbers and constants don't count. A text that is no JSON is a
    leaf itself; null has none."""

    def one(t):
        if t is None:
            return []
        try:
            return _leaves(json.loads(t))
        except ValueError:
            return [t]

    return pd.Series([one(t) if isinstance(t, str) else one(None) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """The same JSON with sorted keys and no white space; a text that is no JSON stays as it is."""

    def one(t):
        try:
            return t if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return t

    return pd.Series([one(t) if isinstance(t, str) else one(None) for t in text], dtype=object)
