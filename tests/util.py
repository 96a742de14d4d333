import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def canon(cols, rows):
    """Order-insensitive canonical form: columns by name, rows sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def local_dir(spark, name):
    """``session.shared_dir`` of a local session as a path for Python's file functions."""
    from regmesh.session import shared_dir
    return shared_dir(spark, name).removeprefix("file:")
