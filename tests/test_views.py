from __future__ import annotations

from pathlib import Path

import pytest

from lectern.plans.views import chunks_at, register

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_views_answer_sql(spark):
    assert len(register(spark, SF)) == 6
    row = spark.sql("SELECT book_id, level FROM lx_chunks LIMIT 1").first()
    got = chunks_at(spark, row.book_id, row.level).collect()
    assert [r.i for r in got] == list(range(len(got)))
    assert spark.sql("SELECT match_score('Das Haus', 'das haus', NULL).score AS s, nfc('a') AS n").first().s == 1.0
