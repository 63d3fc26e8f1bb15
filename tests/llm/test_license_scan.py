from veilspark.llm import license_scan as ls


def test_units_and_spellings(spark):
    mit = ls.KNOWN[3][1]
    rows = [
        (1, "RELEASED under the  MIT licence!!"), (2, "Intro.\nReleased under the MIT License.\nmore"), (3, None), (4, ""), (5, "..."),
        (6, "© 2020 Someone\n" + mit.upper().replace("\n\n", "\n\n\n")), (7, "before\n\n" + mit.split("\n\n", 2)[0]),
        (8, "Licensed under Creative Commons BY NC 4.0"), (9, "unlicensed under the mit license maybe"),
        (None, "Licensed under CC BY-NC 4.0."), (2, "Licensed under the Apache License, Version 2.0\n\nReleased under the MIT License"),
    ]
    docs = spark.createDataFrame([(i, t, "u") for i, t in rows], "doc_id long, text string, units string")
    out = ls.scan(docs, ls.known_digests(spark)).collect()
    got = sorted((r.id if r.id is not None else -1, r.whole_license or "", r.licenses) for r in out)
    assert got == sorted([
        (1, "MIT", "MIT"), (2, "", "MIT"), (3, "", ""), (4, "", ""), (5, "", ""), (6, "MIT", "MIT"), (7, "", ""),
        (8, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (9, "", ""), (-1, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (2, "", "Apache-2.0,MIT"),
    ])
    assert ls.scan(docs.limit(0), ls.known_digests(spark)).count() == 0


def test_paragraph_inside_a_document(spark):
    isc = ls.KNOWN[4][1]
    docs = spark.createDataFrame([(1, "Header\n\n" + isc), (2, "x\n\nThis work is licensed under CC BY 4.0\n\ny")], "doc_id long, text string")
    out = {r.id: r.licenses for r in ls.scan(docs, ls.known_digests(spark)).collect()}
    assert out == {1: "", 2: "CC-BY-4.0"}  # a licence of two paragraphs counts as a whole text only


def test_full_texts_of_common_licences(spark):
    full = dict(ls.full_texts()[::-1])  # of several forms of a name the whole file counts
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-3-Clause", "MPL-2.0", "CC0-1.0"} <= set(full)
    rows = [(n, t.upper().replace("\n", "\r\n")) for n, t in full.items()] + [("terms", full["GPL-3.0"].split("END OF TERMS")[0])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = {r.id: (r.whole_license, r.licenses) for r in ls.scan(docs, ls.known_digests(spark)).collect()}
    assert out == {n: (n, n) for n in full} | {"terms": ("GPL-3.0", "GPL-3.0")}


def test_known_texts_without_the_usual_words(spark):
    docs = spark.createDataFrame([(1, "Do as you whilst please!"), (2, "x\n\nDo as you while\nplease\n\n"), (3, "...")], "doc_id long, text string")
    known = ls.known_digests(spark, [("FREE", "do as you while please"), ("NONE", "...")])
    for table in (known, known.select("license_id", "digest")):
        out = {r.id: (r.whole_license, r.licenses, r.n_matches) for r in ls.scan(docs, table).collect()}
        assert out == {1: ("FREE", "FREE", 1), 2: (None, "FREE", 1), 3: (None, "", 0)}
