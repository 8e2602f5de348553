"""Pages with cut character references: the query against its SQL, and the operator as HTML has it."""

from __future__ import annotations

from quarterlight.operators import pages
from quarterlight.queries import ORACLES, QUERIES
from tests.compare import database, spark_rows, sql_rows

CUT = [
    "<title>a &amp; b &am</title><nav><ul><li>one &lt; two</li></ul></nav><article><h1>a &amp; b &amp</h1><p>c &amp; d</p></article>",
    "<title>a &amp</title><nav><li>n &quot</li></nav><article><h1>a &amp</h1><p>at &amp no &amplifier &ampfoo; &#39 &#39;x&#39;</p></article>",
    "<title>&lt;b&gt; &amp;lt;</title><nav></nav><article><p>ends with &amp",
    "<title>x &gt</title><nav><li>y</li></nav><article><p>z &amp</article>",
]


def test_cut_references_equal_sql(spark, tmp_path, sf_dir):
    rows = spark.createDataFrame([(i, "http://x.org/", h) for i, h in enumerate(CUT)], "page_id long, url string, html string")
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    db = database(sf_dir)
    db.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert spark_rows(QUERIES["html_extract_doc"](spark, str(tmp_path))) == sql_rows(db, ORACLES["html_extract_doc"])


def test_documents_are_read_as_html_has_it():
    assert pages.parse_document(CUT[0])[1] == "one < two a & b & c & d"
    assert pages.parse_closed(CUT[0])[1] == "one < two a & b &amp c & d"
    assert pages.parse_closed(CUT[3])[0] == "x >" and pages.parse_closed("<div>a&amp</div>")[1] == pages.parse_document("<div>a&amp</div>")[1] == "a&amp"
