"""Every catalogue query against its SQL in DuckDB."""

from collections import Counter

import pytest

from posframe import queries, queries_more


#: Transforms, digests, compression, containers and users' functions, which Spark has no built-in for.
PYTHON = {"fourier", "fourier_bins", "compress_round_trip", "compressed_bytes", "zip_entries", "tensor_round_trip", "geometry_files", "keyed_digest", "linear_system", "singular_values_of_diagonals", "vectorised_function", "user_aggregate", "function_for_sql", "rows_of_rows"}


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in row)


@pytest.fixture(scope="module")
def con(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, con, name):
    got = queries.QUERIES[name](spark, data)
    want = con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert Counter(plain(r) for r in got.select(*cols).collect()) == Counter(plain(r) for r in want.project(",".join(f'"{c}"' for c in cols)).fetchall())


def test_the_module_adds_to_the_catalogue():
    assert queries_more.QUERIES is queries.QUERIES


def test_python_runs_only_where_spark_has_no_built_in(spark, data):
    for name, query in queries.QUERIES.items():
        if name in PYTHON or name.startswith("stream_"):
            continue
        plan = query(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = queries.QUERIES["filter_mask"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan
