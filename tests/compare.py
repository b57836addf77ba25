"""Run queries and their SQL side by side: python tests/compare.py [sf] [names...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "long": "int", "bigint": "int", "integer": "int", "int": "int", "hugeint": "huge", "double": "double",
    "float": "float", "string": "string", "varchar": "string", "boolean": "boolean", "decimal": "decimal",
}


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(df, con, sql):
    """Empty string when both agree, else what differs."""
    spark_rows, spark_cols = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    duck_cols = [c[0] for c in cur.description]
    duck_types = {c[0]: str(c[1]).lower() for c in cur.description}
    duck_rows, duck_cols = rows_of(duck_cols, cur.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}"
    for f in df.schema.fields:
        a = f.dataType.typeName()
        b = duck_types[f.name].split("(")[0]
        same = {"number": {"integer", "long", "double", "short"}, "string": {"string"}, "bool": {"boolean"}}
        if b in same and a not in same[b]:
            return f"type of {f.name}: {a} != {b}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows != {len(duck_rows)} rows; {spark_rows[:2]} / {duck_rows[:2]}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"first difference: {a} != {b}"
    return ""


def main(argv):
    from bench import session

    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con, bad = session(8), duck(sf_dir), 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = "" if df.collect() else "no rows"
        except Exception as exc:  # report every failing query, not only the first
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok':5}{name:28}{time.time() - t0:6.1f}s {problem}", flush=True)
    print("failed:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
