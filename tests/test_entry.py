import duckdb
import pytest

import __spark_entry__ as E
from lumenfold.plans import catalog


def normal(rows):
    return sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["proximity_scores", "nearest_spans", "fractional_cells", "portfolio_means", "asof_history", "stratified_draw", "sector_ranks", "fiscal_dates", "joined_with_status", "top_retention", "quantile_bins", "inflected_terms", "attempt_history", "name_reuse"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = E.queries()[name](spark, sf)
    cols = sorted(got.columns)
    wanted = con.sql(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert normal(got.select(cols).collect()) == normal(wanted)


def test_catalog_is_whole(spark):
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert E.entry(spark).limit(1).count() == 1
