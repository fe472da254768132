"""Comparison of a Spark result with SQL: columns by name, rows in any order."""


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v


def same(rows, columns, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(columns)
    order = sorted(columns)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
