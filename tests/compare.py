import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if type(v).__name__ == "Decimal":
        return str(v.normalize())
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    cols = sorted(names)
    return cols, sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall())
