"""Every registered query of the core against its SQL, and the entry points."""

import pytest

from quillmere.plans import governed, heart, places, records, search

CORE = {**search.QUERIES, **heart.QUERIES, **governed.QUERIES, **records.QUERIES, **places.QUERIES}
SQL = {**search.ORACLE_SQL, **heart.ORACLE_SQL, **governed.ORACLE_SQL, **records.ORACLE_SQL, **places.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(same, name):
    same(CORE[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"] and df.count() == 200
    assert set(CORE) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())


def test_sections_cover_pages(spark):
    import re

    from tests.conftest import SF

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in records.section_split(spark, SF).collect():
        got.setdefault(r.page_id, []).append((r.position, r.level, r.char_start, r.char_end))
    for page, html in pages.items():
        heads = [(m.start(), int(m[1])) for m in re.finditer(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", html)]
        ends = [*(h[0] for h in heads[1:]), len(html)]
        want = [(k, lv, at, max(at + 1, end)) for k, ((at, lv), end) in enumerate(zip(heads, ends, strict=True))] or [(0, 0, 0, max(1, len(html)))]
        assert sorted(got[page]) == want
