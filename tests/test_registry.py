from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"
QUICK = ["p3_terms", "p5_found", "t2_clean", "t21_lint_tokens", "q2_flatten", "w1_occurrence", "j2_override_overlay", "k1_chunk_emoji", "w11_display_runs", "a6_piece_stats", "a11_lint_counts", "v3_legal_cuts", "c3_name_guard", "c17_absorb_wordless", "e2_generate_and_grade"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["book_id", "level", "sec_idx", "sent_idx", "ci", "i", "a", "b", "cont", "t"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    theirs, same_columns = verify.sql_rows(verify.open_tables(SF), entry.oracle_sql()[name], columns)
    assert same_columns and verify.spark_rows(df, columns) == theirs
