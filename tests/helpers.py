"""Results of both engines as comparable rows."""

def plain(v):
    """A value as text that is equal in both engines."""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())
