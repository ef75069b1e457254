"""Rows of two frames as sorted tuples of texts, columns by name."""

import pandas as pd


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return repr(int(v) if v.is_integer() else round(v, 9))
    if hasattr(v, "tolist") and not hasattr(v, "item") or hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return repr([text(x) for x in v])
    return repr(v.item() if hasattr(v, "item") else v)


def rows(pdf):
    return sorted(tuple(text(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
