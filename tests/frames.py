"""Plain Python views of frames, for tests of any folder."""


def rows(df, *cols, by=None):
    """Rows as tuples, sorted, of the given columns."""
    names = cols or df.columns
    out = [tuple(r[c] for c in names) for r in df.collect()]
    return sorted(out, key=str) if by is None else sorted(out, key=by)
