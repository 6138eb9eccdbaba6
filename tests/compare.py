"""Run registered queries next to their SQL twins and compare the results.

    python tests/compare.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
        return _cell(v) if not isinstance(v, list) else tuple(_cell(x) for x in v)
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    if isinstance(v, bool):
        return v
    return v


def _key(row):
    return tuple((x is not None, str(type(x).__name__ in ("int", "float", "bool")), str(x)) for x in row)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_df, con, sql):
    """Return '' when equal, else a description of the first difference."""
    cols = sorted(spark_df.columns)
    got = sorted(([_cell(r[c]) for c in cols] for r in spark_df.collect()), key=_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(([_cell(r[i]) for i in order] for r in cur.fetchall()), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    for g, w in zip(got, want):
        for c, a, b in zip(cols, g, w):
            if a == b:
                if isinstance(a, bool) != isinstance(b, bool) or isinstance(a, float) != isinstance(b, float):
                    return f"type of {c}: {a!r} vs {b!r}"
                continue
            if isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9):
                continue
            return f"{c}: {a!r} vs {b!r} in {g} vs {w}"
    return "" if got else "EMPTY"


def main():
    from sievewell.plans import plans
    from sievewell.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    parts = [a for a in args if not a.startswith("/")]
    spark = local_session("compare", "8")
    con = duck(sf_dir)
    bad = 0
    for name, p in plans().items():
        if parts and not any(x in name for x in parts):
            continue
        t = time.time()
        try:
            df = p.run(spark, sf_dir)
            if p.sql:
                verdict = compare(df, con, p.sql) or "ok"
            else:
                n = df.count()
                verdict = f"rows-only {n}" if n else "EMPTY"
        except Exception as e:
            verdict = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        if not (verdict == "ok" or verdict.startswith("rows-only")):
            bad += 1
        print(f"{time.time() - t:6.2f}s {name:40s} {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
