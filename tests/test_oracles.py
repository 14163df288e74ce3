"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import numpy as np
import pytest

from sparkcells.oracles import ORACLES
from sparkcells.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).values.tolist()), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries that SQL can't state, with the columns they give.
COLUMNS = {
    "cell_network": ["a", "b", "corr"],
    "corr_pvalues": ["gene", "corr", "pval"],
    "corr_store_pvalues": ["condition", "gene", "corr", "pval"],
    "hierarchy_strips": ["resolution", "grp", "gene", "json"],
    "logistic_auc": ["class", "auc"],
    "lr_transfer": ["cell_id", "label", "given"],
    "marker_auto": ["grp", "gene", "score", "rank"],
    "welch_filter": ["start", "end", "gene", "fc", "delta", "ttest_pval"],
    "welch_summary": ["grp", "gene", "ttest_pval", "ttest_n_start", "ttest_n_end"],
}


def test_every_query_is_tested():
    assert set(COLUMNS) == set(QUERIES) - set(ORACLES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_runs(spark, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    # the smallest tables have too few cells a batch for any p value to sum up; test_micro has the sums
    assert found.columns.tolist() == COLUMNS[name] and (len(found) > 0 or name == "welch_summary")
    for column in ("pval", "ttest_pval", "auc"):
        if column in found:
            assert found[column].dropna().between(0, 1).all()


def tail(t, df):
    """Two-sided p of Student's t by adding up its density."""
    x = (np.arange(400_000) + 0.5) / 400_000 * np.pi / 2  # t = sqrt(df) * tan(x)
    inside = x < np.arctan(abs(t) / np.sqrt(df))
    density = np.cos(x) ** (df - 1)
    return 1 - density[inside].sum() / density.sum()


def test_welch_p_values(spark):
    """The filter keeps what has no p or one below the limit; the p follow from t and df."""
    tested = QUERIES["welch_t"](spark, SMALL).toPandas()
    want = {}
    for r in tested.itertuples():
        p = None if r.t is None or np.isnan(r.t) else tail(r.t, r.df)
        if p is None or p < 0.01:
            want[r.start, r.end, r.gene] = p
    found = {(r["start"], r["end"], r["gene"]): r["ttest_pval"] for r in QUERIES["welch_filter"](spark, SMALL).collect()}
    assert set(found) == set(want)
    assert all((found[k] is None) == (want[k] is None) and (want[k] is None or abs(found[k] - want[k]) < 1e-4) for k in want)


def test_correlation_p_values(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id is not null").count()
    t = {r["gene"]: r["t"] for r in QUERIES["corr_one_vs_all"](spark, SMALL).collect()}
    for r in QUERIES["corr_pvalues"](spark, SMALL).collect()[:40]:
        if r["pval"] is not None and t[r["gene"]] is not None:
            assert abs(r["pval"] - tail(t[r["gene"]], n - 2)) < 1e-4


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["grp", "gene", "score", "rank"]
