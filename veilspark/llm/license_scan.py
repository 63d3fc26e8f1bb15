"""Licence scan by canonical digests.

The units of a document are its whole text, its paragraphs and its lines. A
canonical form drops copyright lines, lower-cases, unifies equivalent spellings
and reduces everything else than letters and digits to single spaces. The digest
of each unit's canonical form is hash-joined to the digests of known licence
texts, made by the same expressions. Known are the full texts in ``licenses/``
and the short texts and notices in ``KNOWN``. All work is native.

Results for odd input: a null text counts as empty and matches nothing; units
without a letter or digit match nothing; a null id is kept as null; repeated
rows each give a row; a very long text is scanned whole, and held as a whole by
the task that cuts it into units; an empty table gives no rows; other columns are
not used.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import sha256_hex, text_or_empty
from veilspark.session import materialise

# Public licence texts and the short notices that stand for them.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
)
# Spellings that count as the same word, after lower-casing and reduction to words.
SAME_WORD = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("authorisation", "authorization"),
    ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("noncommercial", "non commercial"), ("whilst", "while"), ("creative commons", "cc"),
    ("attribution noncommercial", "by nc"), ("v2", "version 2"), ("v3", "version 3"),
)
_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
_END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def canonical(text: Column, separators: str = "") -> Column:
    """Lower case, no copyright lines, one space for anything but letters, digits and ``separators``."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "")
    return F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{separators}]+", " ")


def words_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def same_words(text: Column) -> Column:
    """One spelling for words that count as the same."""
    for spelling, word in SAME_WORD:
        text = F.regexp_replace(text, rf"\b{spelling}\b", word)
    return text


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the files in ``licenses/``; where advice follows the terms, the terms alone too."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        terms, mark, _ = text.partition(_END_OF_TERMS)
        out += [(name, text)] + ([(name, terms + mark), (name, terms)] if mark else [])
    return out


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """license_id, digest, probe (a hash that is cheaper than the digest) of each distinct canonical text.

    ``known`` is (license_id, text); without it, ``KNOWN`` and ``full_texts``.
    """
    texts = spark.createDataFrame(list(known) if known is not None else [*KNOWN, *full_texts()], "license_id string, text string")
    canon = texts.select("license_id", same_words(words_only(canonical(F.col("text")))).alias("canon"))
    return canon.select("license_id", sha256_hex(F.col("canon")).alias("digest"), F.xxhash64("canon").alias("probe")).distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_digest, whole_license, licenses (sorted, distinct), n_matches.

    ``known`` (license_id, digest, and probe if it has one) is configuration, small
    enough for Spark to broadcast by its own measure. Only units with a known probe
    get a digest; without probes all do. Rows get a number inside the query, so
    that repeated ids stay apart.
    """
    probes = [r.probe for r in known.select("probe").distinct().collect()] if "probe" in known.columns else None
    canon = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        canonical(text_or_empty(text_col), r"\n").alias("canon"),
    ).withColumn("whole", words_only(F.col("canon")))
    spelled = "|".join(rf"\b{s}\b" for s, _ in SAME_WORD)
    tidy = F.trim(F.regexp_replace("canon", " *\n *", "\n"))
    blocks = F.transform(F.split(tidy, "\n\n+"), lambda x: F.trim(F.translate(x, "\n", " ")))
    lines = F.split(tidy, "\n")
    units = F.concat(F.array("whole"), blocks, lines)
    # A unit is a run of words of the whole text, so it has no spelling that the whole text lacks.
    units = F.when(F.col("whole").rlike(spelled), F.transform(units, same_words)).otherwise(units)
    wanted = F.filter(units, lambda u: (u != "") & (F.lit(True) if probes is None else F.xxhash64(u).isin(probes)))
    # Written once: a digest per row and those of the few likely units; row numbers are fixed from here on.
    rows = materialise(canon.select(
        "row", "id",
        sha256_hex(F.when(F.col("whole").rlike(spelled), same_words(F.col("whole"))).otherwise(F.col("whole")))
        .alias("text_digest"),
        F.array_distinct(F.transform(wanted, sha256_hex)).alias("digests"),
    ), "license-units")
    found = (
        rows.select("row", "text_digest", F.explode("digests").alias("digest"))
        .join(known.select("license_id", "digest"), "digest")
        .groupBy("row").agg(
            F.min(F.when(F.col("digest") == F.col("text_digest"), F.col("license_id"))).alias("whole_license"),
            F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("licenses"),
            F.count(F.lit(1)).alias("n_matches"),
        )
    )
    return rows.select("row", "id", "text_digest").join(found, "row", "left").select(
        "id", "text_digest", "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )
