"""Order-insensitive comparison of a Spark query with its SQL."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: KINDS.get(df.schema[c].dataType.simpleString(), kinds[c]) for c in columns} == kinds
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
