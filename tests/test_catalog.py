"""Every query over the reference operators against its SQL twin at sf0.001."""

import duckdb
import pyarrow.parquet as pq
import pytest
from compare import same
from conftest import DATA

from gridspectra.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    if name in ORACLES:
        same(got, duck.sql(ORACLES[name]).df())
    assert len(got)


@pytest.mark.parametrize("name", ["lost_bbox", "lost_bbox_clipped", "entry_localize", "entry_localize_all", "sign_rule", "label_files"])
def test_query_where_an_image_lacks_patches(name, spark, tmp_path):
    """The last of three images ends in the middle of a row, and the first lacks patches within."""
    own = pq.read_table(f"{DATA}/sf0.1/embeddings.parquet").to_pandas().query("vec_id < 256 and vec_id not in (0, 23, 24, 71)")
    own.to_parquet(tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    same(QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).collect()[0].miou > 0
    assert set(e.oracle_sql()) <= set(e.queries())
