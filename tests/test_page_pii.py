from veilspark.plans import QUERIES


def test_attribute_values_in_all_forms(spark, tmp_path):
    rows = [
        (1, '<input value="a@b.com">'), (2, "<input value='a@b.com'>"), (3, "<a href=mailto:a@b.com>x</a>"), (4, "<p>nothing = here</p>"),
        (5, "<a href=/x?m=c@d.org title='e@f.org' alt=\"g@h.org\">x</a>"), (6, "<input value='a&#64;b.com'>"),
    ]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r.findings for r in QUERIES["page_pii"](spark, str(tmp_path)).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 0, 5: 3, 6: 1}
