"""Fixtures that every operator must bear: nulls, empty and very long texts, ties, repeats, clashing names."""

import duckdb

from oracle_check import rows_of

#: Names that operators use for columns of their own.
EXTRA = ["fp", "h", "key", "score", "nr", "block", "cycle", "slot", "n", "start", "component_id", "lang", "q", "row"]
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
TEXTS = [(1, None), (2, ""), (2, ""), (3, "   \n\t "), (4, "one two three four five six seven"), (5, "one two three four five six seven"),
         (6, LONG), (7, LONG), (None, "no id here"), (None, None), (8, "Ünï çödé 中文 \U0001f600 text"), (9, "solo")]


def documents(spark, rows=None, source=None):
    """``documents`` with columns that clash with the operators' own."""
    rows = TEXTS if rows is None else rows
    data = [(i, t, (source(i) if source else None if i is None else f"s{i % 3}"), *([-1] * len(EXTRA))) for i, t in rows]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame(data, schema)


def same_as_sql(df, tables, sql):
    """Compare with DuckDB over pandas tables."""
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    a, b = rows_of(df.toPandas()), rows_of(con.execute(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1], (list((a[1] - b[1]).items())[:3], list((b[1] - a[1]).items())[:3])
