import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from sieveline.plans import catalogue

from .test_twins import plain


def test_a_mean_is_rounded_before_it_is_held_against_the_least(spark, tmp_path):
    grids = np.zeros((5, 16), "f4")
    grids[0, :3] = 0.1399997  # 0.14 when rounded
    grids[1, :3] = 0.1399994
    grids[2, :3] = 0.14
    grids[3, 6:9] = 0.2, np.nan, 0.3
    rows = grids.tolist()
    rows[4] = [None, 0.2, 0.2, 0.2, None, 0.5, 0.5, 0.5]
    pq.write_table(pa.table({"vec_id": range(5), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    found = catalogue.queries()["connected_components"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalogue.oracles()['connected_components']})").fetchall()
    assert plain(found.collect()) == plain(want)
    assert sorted(r.vec_id for r in found.collect()) == [0, 2, 3, 4, 4]
