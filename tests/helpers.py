"""Comparison with DuckDB on the same parquet files."""

import glob
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sql, sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con.execute(sql).df()


def canon(pdf):
    """Rows as sorted tuples, columns by name."""
    import math

    def val(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return "null" if math.isnan(x) else f"{float(x):.6f}"
        if type(x).__name__ in ("NaTType", "NAType"):
            return "null"
        return str(x)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(val(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def agree(df, sql, sf_dir=SF):
    got, want = canon(df.toPandas()), canon(duck(sql, sf_dir))
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, (len(bad), bad[:3])
