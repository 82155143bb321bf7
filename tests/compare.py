"""Order-free comparison of a Spark frame with a relation of the SQL engine."""

import math


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())
