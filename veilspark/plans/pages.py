"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.operators import classify as C
from veilspark.operators import elements as E
from veilspark.operators import scan as S
from veilspark.operators import vault as V
from veilspark.plans import sqlparts as Q
from veilspark.plans.derived import load
from veilspark.plans.registry import query
from veilspark.session import spread
from veilspark.sources import html as H


def pages(spark, sf_dir, *columns: str):
    return spread(load(spark, sf_dir, "pages").select("page_id", *columns), "page_id")


_CLEAN = r"""clean AS (SELECT page_id, url, regexp_replace(html,
    '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS h FROM pages)"""


def _unescape(e: str) -> str:
    for entity, char in H._ENTITIES:
        e = f"replace({e}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return e


_TEXT = "trim(regexp_replace(" + _unescape("regexp_replace({e}, '<[^>]*>', '', 'g')") + r", '\s+', ' ', 'g'))"


@query(
    "page_links",
    rf"""WITH {_CLEAN}, a AS (SELECT page_id, regexp_extract_all(h, '<a href="([^"]*)">', 1) AS hrefs,
        regexp_extract_all(h, '(?s)<a href="[^"]*">(.*?)</a>', 1) AS texts FROM clean)
    SELECT page_id, unnest(range(len(hrefs))) AS pos, 'a' AS tag, {_unescape('unnest(hrefs)')} AS href,
           substr({_TEXT.format(e='unnest(texts)')}, 1, {fixed.TEXT_CHARS}) AS text, true AS visible FROM a""",
)
def page_links(spark, sf_dir):
    links = H.snapshot_elements(pages(spark, sf_dir, "html"))
    return links.select("page_id", "pos", "tag", "href", F.substring("text", 1, fixed.TEXT_CHARS).alias("text"), "visible")


@query(
    "page_url_strip",
    rf"""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url,
        substr({_TEXT.format(e="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, {fixed.TITLE_CHARS}) AS title FROM pages""",
)
def page_url_strip(spark, sf_dir):
    return pages(spark, sf_dir, "url", "html").select(
        "page_id", E.strip_url(F.col("url")).alias("url"), H.page_title(F.col("html")).alias("title")
    )


@query(
    "page_element_cap",
    rf"""WITH {_CLEAN} SELECT page_id, least(5, len(regexp_extract_all(h, '<a href="([^"]*)">', 1))) AS kept,
        len(regexp_extract_all(h, '<a href="([^"]*)">', 1)) AS found FROM clean
        WHERE len(regexp_extract_all(h, '<a href="([^"]*)">', 1)) > 0""",
)
def page_element_cap(spark, sf_dir):
    rows = H.snapshot_elements(pages(spark, sf_dir, "html"))
    return rows.groupBy("page_id").agg(
        F.count_if(F.col("pos") < 5).alias("kept"), F.count("*").alias("found")
    )


_FORM = """concat('<form><label for="em', k, '">Your e-mail</label><input id="em', k, '" type="email" class="a  b c" value="u', k,
    '@example.com" style="left:10px;top:', k % 50, 'px;width:200px;height:', k % 3, 'px"><select name="s"><option value="x">X</option>',
    '<option value="y', k % 5, '" selected>Y</option></select><textarea aria-label="Note">a &amp; b ', k, '</textarea>',
    '<button type=submit', CASE WHEN k % 4 = 0 THEN ' hidden' ELSE '' END, '>Send <b>now</b></button><img src="p.png" alt="Profile photo ', k, '"></form>')"""


@query(
    "page_form_elements",
    f"""WITH h AS (SELECT page_id, page_id AS k, len(regexp_extract_all(regexp_replace(html,
            '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<a href="([^"]*)">')) AS n FROM pages)
    SELECT page_id, n + i AS pos, ['label', 'input', 'select', 'textarea', 'button', 'img'][i + 1] AS tag,
        CASE i WHEN 1 THEN concat('u', k, '@example.com') WHEN 2 THEN concat('y', k % 5) WHEN 3 THEN concat('a & b ', k) END AS value,
        CASE i WHEN 3 THEN 'Note' WHEN 2 THEN 's' END AS label, CASE i WHEN 4 THEN 'Send now' END AS text,
        CASE i WHEN 1 THEN k % 3 >= 2 WHEN 4 THEN k % 4 <> 0 ELSE true END AS visible,
        CASE i WHEN 1 THEN 3 ELSE 0 END AS n_classes, CASE i WHEN 5 THEN concat('Profile photo ', k) END AS img_hints
    FROM h, range(6) r(i)""",
)
def page_form_elements(spark, sf_dir):
    """Element rows of each page with a form appended to its own markup."""
    src = pages(spark, sf_dir, "html").withColumn("k", F.col("page_id"))
    with_form = src.select("page_id", F.concat("html", F.expr(_FORM)).alias("html"))
    return (
        H.snapshot_elements(with_form)
        .filter(F.col("tag") != "a")
        .select("page_id", "pos", "tag", "value", "label", "text", "visible", F.size("classes").alias("n_classes"), "img_hints")
    )


# Labels around their field, for it, both, and never closed; a select in a label; a button with nested markup.
_NESTED = """concat('<form><label>Card <b>number</b> <input id="c', k, '"></label><label for="d', k, '">Born ', k, '<p></label>',
    '<div><input id="d', k, '" aria-label="unused"></div><label>Colour <select name="s"><option>Red<option selected>Blue', k, '</select></label>',
    '<label for="e', k, '"> </label><label>Outer <input id="e', k, '" placeholder="p"></label><input name="n', k, '">',
    '<button>Pay <span>', k, ' <i>now</i></span></button><div role="button"><div>Go</div> on</div><label>Open <input id="f', k, '"></form>')"""
_RESOLVED = """['Card number', 'Born ' || k, 'Colour RedBlue' || k, 'Outer', 'n' || k, NULL, NULL, 'Open']"""


@query(
    "page_labels",
    f"""WITH h AS (SELECT page_id, page_id AS k, len(regexp_extract_all(regexp_replace(html,
            '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<a href="([^"]*)">')) AS n FROM pages)
    SELECT page_id, n + [1, 3, 5, 8, 9, 10, 11, 13][i] AS pos, ['input', 'input', 'select', 'input', 'input', 'button', 'div', 'input'][i] AS tag,
        {_RESOLVED}[i] AS resolved_label, CASE i WHEN 6 THEN 'Pay ' || k || ' now' WHEN 7 THEN 'Go on' END AS text,
        CASE WHEN i = 3 THEN 'Blue' || k WHEN i IN (1, 2, 4, 5, 8) THEN '' END AS value
    FROM h, range(1, 9) r(i)""",
)
def page_labels(spark, sf_dir):
    """Labels, texts and values of fields in nested and unclosed markup after each page's own."""
    src = pages(spark, sf_dir, "html").withColumn("k", F.col("page_id"))
    rows = H.snapshot_elements(src.select("page_id", F.concat("html", F.expr(_NESTED)).alias("html")))
    return rows.filter(~F.col("tag").isin("a", "label")).select("page_id", "pos", "tag", "resolved_label", "text", "value")


# A form without any inline size, as most pages have it.
_BARE_FORM = """concat('<form><label for="m', k, '">Mail</label><input id="m', k, '" type="email" value="p', k, '&#64;example.com">',
    '<input type="password" name="pw', k, '" value="s3cret', k, '"><input name="cc" autocomplete="cc-number" value="4111 1111 1111 1111">',
    '<select name="colour"><option>Red</option></select><input name="q" value="shoes"></form>')"""
_FOUND = """h AS (SELECT page_id, page_id AS k, len(regexp_extract_all(regexp_replace(html,
            '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<a href="([^"]*)">')) AS n FROM pages),
    found AS (SELECT page_id, n + i AS pos, ['email', 'password', 'credit_card'][i] AS pii_type,
        ['USER_EMAIL', 'USER_PASSWORD', 'CARD_NUMBER'][i] AS kind,
        ['p' || k || '@example.com', 's3cret' || k, '4111 1111 1111 1111'][i] AS value FROM h, range(1, 4) r(i))"""


def bare_forms(spark, sf_dir):
    """Elements of each page with a form appended that says nothing about its layout."""
    src = pages(spark, sf_dir, "html").withColumn("k", F.col("page_id"))
    with_form = src.select("page_id", F.concat("html", F.expr(_BARE_FORM)).alias("html"))
    return H.snapshot_elements(with_form)


# Texts whose findings stand behind the sixtieth character, where a payload has long been cut.
_OFFER = "concat('read the terms of this offer and of all others, or else write to u', k, '@example.com')"
_CARD = "concat('xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 4111 1111 1111 1111 ', k)"


@query(
    "page_violations",
    rf"""WITH {_CLEAN}, a AS (SELECT page_id, regexp_extract_all(h, '(?s)<a href="[^"]*">(.*?)</a>', 1) AS texts FROM clean),
    el AS (SELECT page_id, concat('dom_elements[e', pos, '].text') AS place, {_TEXT.format(e='t')} AS body
           FROM (SELECT page_id, unnest(range(len(texts))) AS pos, unnest(texts) AS t FROM a)
        UNION ALL SELECT page_id, concat('dom_elements[#b', k, '].text'), {_OFFER} FROM (SELECT page_id, page_id AS k FROM a)
        UNION ALL SELECT page_id, concat('dom_elements[e', len(texts) + 1, '].text'), {_CARD} FROM (SELECT page_id, page_id AS k, texts FROM a))
    SELECT page_id, place AS "where", pii_type, {Q.audit_hint('pii_type', 'value')} AS hint FROM ({Q.findings('el', 'body', 'page_id', 'place')})""",
)
def page_violations(spark, sf_dir):
    """Audit of the whole texts of all elements of pages, with two long ones appended."""
    src = pages(spark, sf_dir, "html").withColumn("k", F.col("page_id"))
    more = F.concat(F.lit('<button id="b'), "k", F.lit('">'), F.expr(_OFFER), F.lit('</button><a href="/">'), F.expr(_CARD), F.lit("</a>"))
    rows = H.snapshot_elements(src.select("page_id", F.concat("html", more).alias("html")))
    return S.element_violations(rows, "page_id").drop("reason")


@query("page_detections", f"WITH {_FOUND} SELECT page_id, pos, pii_type FROM found")
def page_detections(spark, sf_dir):
    """Detections on raw pages, links and all."""
    found = C.detections(C.with_detection(bare_forms(spark, sf_dir)), "page_id")
    return found.select("page_id", "pos", "pii_type")


@query(
    "page_tokens",
    f"""WITH {_FOUND} SELECT page_id, pos, md5(value) AS raw_md5, concat('[', kind, '_', row_number() OVER
        (PARTITION BY page_id % 10, kind ORDER BY page_id // 10, page_id, pos), ']') AS token FROM found""",
)
def page_tokens(spark, sf_dir):
    """Tokens of what is found on raw pages; ten sessions visit the pages one after the other."""
    steps = bare_forms(spark, sf_dir).withColumns(
        {"session_id": F.col("page_id") % 10, "step": F.floor(F.col("page_id") / 10)}
    )
    tagged = V.attach_detection(C.with_detection(steps), ["page_id"])
    return V.tokens(tagged).select("page_id", "pos", "token", F.md5("value").alias("raw_md5"))
