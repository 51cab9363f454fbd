"""Helpers of the tests: expressions over a few rows, and queries against DuckDB."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"
HAS_TABLES = os.path.isdir(SMALL)


def on(spark, rows, schema, *cols):
    """The values of expressions over rows, in the rows' order; bare values for one expression."""
    d = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"_i int, {schema}")
    out = d.select("_i", *[c.alias(f"_c{k}") for k, c in enumerate(cols)]).collect()
    out = [tuple(r)[1:] for r in sorted(out, key=lambda r: r["_i"])]
    return [r[0] for r in out] if len(cols) == 1 else out


def duck(sf_dir=SMALL):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def hashable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: repr(round(x, 9) + 0.0) if isinstance(x, float) else repr(x)
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def same_as_sql(spark, connection, query, sql, sf_dir=SMALL):
    df = query(spark, sf_dir)
    ours = hashable(df.columns, [tuple(r) for r in df.collect()])
    found = connection.execute(sql)
    return ours == hashable([x[0] for x in found.description], found.fetchall()) and bool(ours[1])
