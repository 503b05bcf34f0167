"""Queries against their SQL on rows that the test tables hold rarely or not at all."""

from __future__ import annotations

import duckdb

from driftlex.plans import registry
from driftlex.sources import files


def by_sql(folder, name, query):
    with duckdb.connect() as c:
        c.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
        return sorted(c.execute(registry.ORACLE_SQL[query]).fetchall(), key=repr)


def by_spark(spark, folder, query):
    return sorted(map(tuple, registry.QUERIES[query](spark, str(folder)).collect()), key=repr)


def test_references_cut_short(spark, tmp_path):
    pages = [
        "<title>token = &quot</title><p>token = &quot;a&quot; &quo &am &amp &amp;",
        "&lt &gt &nbsp &copy 2 &#39 &#x27; &eacute; &AMP; &amp;lt; &amp;amp; &ampquot;",
        "&lt;b&gt; &#39;x&#39;&nbsp;&nbsp;y &middot;&copy;",
        "a<styleé>kept?<script>x</script\x0b>y</script\f>z",
        "",
        None,
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = by_spark(spark, tmp_path, "html_to_text")
    assert got == by_sql(tmp_path, "pages", "html_to_text")
    assert dict(got)[0] == 'token = &quot token = "a" &quo &am & &'


#: Cells that CSV easily changes: empty, blanks at the ends, line breaks, quotes, zero bytes, marks of nulls.
CELLS = ["", " ", "a", "a ", " a", "\ta", "a\n", "\n", "a\r\nb", "a\rb", '"', '""', '"a" b', 'b "a"', "a\0\"b", "\0\n", "a,b", "\\", "\\\"", "#a", "NULL", "null", "\ufeffa", "\x1f"]


def test_cells_through_csv(spark, tmp_path):
    rows = list(enumerate([*CELLS, None]))
    files.write_csv(spark.createDataFrame(rows, "i int, text string"), str(tmp_path / "cells"))
    got = {int(r.i): r.text for r in files.read_csv(spark, str(tmp_path / "cells")).collect()}
    assert got == dict(rows)


def test_shards_with_odd_texts(spark, tmp_path):
    rows = [(i, t, "en", f"src{i % 2}") for i, t in enumerate(c for c in [*CELLS, "a", None] for _ in range(2))]
    rows.append((None, "", None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_spark(spark, tmp_path, "merged_shards")
    assert got == by_sql(tmp_path, "documents", "merged_shards")
    assert {r[0]: r[3] for r in got} == {"CC-MAIN-2013-05": len(CELLS), "CC-MAIN-2014-06": len(CELLS), None: 1}
