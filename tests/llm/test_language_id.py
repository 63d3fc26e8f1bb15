from pyspark.sql import functions as F

from veilspark.llm import language_id as li

SF = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, declared string, host string, lang_note string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    model = li.fit_text(docs.where("doc_id % 3 <> 0"), "lang", "text")
    out = li.identify(docs.where("doc_id % 3 = 0").withColumnRenamed("lang", "truth"), model)
    right, all_ = out.agg(F.count_if(F.col("lang") == F.col("truth")), F.count(F.lit(1))).first()
    assert right >= 0.98 * all_


def test_evidence_beside_the_text(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", F.col("lang").alias("declared"), F.lit("h").alias("_pad"))
    model = li.fit_text(docs, "declared", "text")
    hosts = docs.withColumn("host", F.concat("declared", F.lit(".site."), "declared"))
    extra = spark.createDataFrame(
        [(-1, "", None, "fr.site.fr"), (-2, "12", "de", None), (-3, "Привет " * 20, "en", "en.site.en"),
         (-4, "123", None, "www.other.es"), (-5, None, None, None), (-6, "", "fr", "fr.site.fr"), (None, "the and of that with", "en", "x")],
        "doc_id long, text string, declared string, host string")
    rows = hosts.select("doc_id", "text", "declared", "host").union(extra).union(extra)
    out = [r for r in li.identify(rows, model, declared_col="declared", host_col="host").collect() if r.doc_id is None or r.doc_id < 0]
    assert len(out) == 14
    got = {r.doc_id: (r.lang, r.accepted) for r in out}
    assert got[-1] == ("fr", True) and got[-2] == ("de", True) and got[-4] == ("es", True) and got[-6] == ("fr", True)
    assert got[-3] == ("und", False) and got[None] == ("en", True)
    assert all(r.posterior is not None and 0 <= r.posterior <= 1 + 1e-9 for r in out)


def test_no_labels_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, None, "x")], SCHEMA)
    model = li.fit_text(docs, "declared", "text")
    assert model.languages == (li.UNKNOWN,)
    out = li.identify(docs, model, declared_col="declared", host_col="host").first()
    assert (out.lang, out.accepted, out.lang_note) == ("und", False, "x")
    assert li.identify(docs.limit(0), model).count() == 0


def test_registered_domains(spark):
    rows = spark.createDataFrame([("www.a.example.com",), ("localhost",), ("b.org",)], "h string")
    got = [tuple(r) for r in rows.select(li.domain_of(F.col("h")), li.suffix_of(F.col("h"))).collect()]
    assert got == [("example.com", "com"), ("localhost", ""), ("b.org", "org")]
    rows = spark.createDataFrame([("www.a.co.uk",), ("x.y.com.br",), ("co.uk",)], "h string")
    assert [r[0] for r in rows.select(li.domain_of(F.col("h"))).collect()] == ["a.co.uk", "y.com.br", "co.uk"]


def test_tags_of_labels_and_declarations(spark):
    rows = spark.createDataFrame([("en-US",), ("FIL",), ("gsw",), (" de_AT ",), ("",), (None,), ("x",), ("12",)], "t string")
    assert [r[0] for r in rows.select(li.subtag("t")).collect()] == ["en", "fil", "gsw", "de", None, None, None, None]
    docs = spark.read.parquet(SF).select("text", F.concat("lang", F.lit("-XX")).alias("label"))
    assert set(li.fit_text(docs, "label", "text").languages) == {"de", "en", "es", "fr", li.UNKNOWN}


def test_clashing_names(spark, tmp_path):
    names = ["lang", "posterior", "Letters", "accepted", "evidence", "said", "_key", "declared", "host", "row", "prior", "logs", "suffix", "at"]
    docs = spark.createDataFrame([("some plain words of a text", *["x"] * len(names))], ", ".join(f"`{n}` string" for n in ["text", *names]))
    model = li.fit_text(docs, "declared", "text")
    out = li.identify(docs, model, declared_col="declared", host_col="host")
    out.write.parquet(str(tmp_path / "out"))
    kept = [n for n in names if n.lower() not in li.RESULTS]
    assert out.columns == [*kept, *li.RESULTS] and [out.first()[n] for n in kept] == ["x"] * len(kept)


def _plain(rows, model, columns):
    """Posterior of every row by the formulas alone; rows: (text, declared, host)."""
    import math

    import numpy as np
    import pyarrow as pa

    langs = model.languages
    k = len(langs)
    score, letters = model.score(pa.array([t or "" for t, _, _ in rows]))
    evidence = [[s * min(n, li.EVIDENCE_LETTERS) / max(n, 1) for s in row] for row, n in zip(score.tolist(), letters.tolist(), strict=True)]
    said = [langs[int(np.argmax(e))] if n >= 20 else None for e, n in zip(evidence, letters.tolist(), strict=True)]

    def counts(values):
        out = {}
        for v, s in zip(values, said, strict=True):
            if v:
                one = out.setdefault(v, [0] * k)
                if s:
                    one[langs.index(s)] += 1
        return out

    def smooth(c, above):
        return above if c is None else [(n + li.SMOOTHING * p) / (sum(c) + li.SMOOTHING) for n, p in zip(c, above, strict=True)]

    all_said = [said.count(x) for x in langs]
    prior = [(n + li.SMOOTHING / k) / (sum(all_said) + li.SMOOTHING) for n in all_said]
    hosts = [h for _, _, h in rows]
    levels = [[(h or "").rpartition(".")[2] if "." in (h or "") else None for h in hosts], [".".join((h or "").split(".")[-2:]) or None for h in hosts], hosts]
    tables, declared = [counts(v) for v in levels], counts([d for _, d, _ in rows])
    out = []
    for i, (_, d, _) in enumerate(rows):
        level = prior
        for table, values in zip(tables, levels, strict=True):
            level = smooth(table.get(values[i]), level)
        share = smooth(declared.get(d), prior)
        logs = [e + math.log(p) + math.log(s / q) for e, p, s, q in zip(evidence[i], level, share, prior, strict=True)]
        top = max(logs)
        out.append((langs[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs)))
    return out


def test_posteriors_against_plain_python(spark):
    docs = spark.read.parquet(SF).select("doc_id", F.substring("text", 1, 60).alias("text"), F.col("lang").alias("declared"))
    model = li.fit_text(docs, "declared", "text")
    rows = [(r.text if r.doc_id % 5 else (r.text or "")[:9], None if r.doc_id % 7 == 0 else r.declared,
             None if r.doc_id % 6 == 0 else f"h{r.doc_id % 4}.site{r.doc_id % 3}.{r.declared}") for r in docs.collect()]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, host string")
    got = {r.doc_id: (r.lang, r.posterior) for r in li.identify(df, model, declared_col="declared", host_col="host").collect()}
    for i, (lang, posterior) in enumerate(_plain(rows, model, None)):
        assert got[i][0] == lang and abs(got[i][1] - posterior) < 1e-6


def test_pages_against_plain_python(spark):
    import re

    from veilspark.llm import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    model = li.fit_text(docs, "lang", "text")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    tags = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;")
    rows = []
    for p in pages:
        declared = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", p.html or "")
        host = re.search(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", p.url or "")
        rows.append((tags.sub(" ", p.html or ""), declared[1].lower() if declared else None, host[1].lower() if host else None))
    got = {r.page_id: (r.lang, r.posterior) for r in QUERIES["page_language"](spark, sf).collect()}
    assert len(got) == len(pages)
    for p, (lang, posterior) in zip(pages, _plain(rows, model, None), strict=True):
        assert got[p.page_id][0] == lang and abs(got[p.page_id][1] - posterior) < 1e-6
