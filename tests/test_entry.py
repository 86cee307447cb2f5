import ast
from pathlib import Path

import duckdb
import pytest

from cohortica import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW_ANYWAY = ["q_g2_long", "q_g3_g7_wide_last", "q_g11_qc_sheet", "q_g13_e15_skipped_sheet", "q_c2_c12_label_metrics", "q_j3_job_state", "q_h19_h20_licences", "q_e17_e21_size_rollup", "q_l3_voxel_to_pixel", "q_n5_f8_outliers", "q_g4_g5_wide_suffix", "q_i1_f6_row_order", "q_e13_pivot_cells", "q_a12_job_files", "q_h22_containment", "q_j10_j11_outcomes"]


@pytest.mark.parametrize("name", SLOW_ANYWAY)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = db.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    flat = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert flat(ours) == flat(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_corpus_operators():
    root = Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path
