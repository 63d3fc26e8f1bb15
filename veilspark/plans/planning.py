"""Queries over planned actions, prompts, targets and submitted forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.operators import elements as E
from veilspark.operators import flow as W
from veilspark.operators import planning as L
from veilspark.operators import providers as R
from veilspark.operators import quality as K
from veilspark.plans import derived as D
from veilspark.plans import sqlparts as Q
from veilspark.plans.registry import query
from veilspark.session import WORK_ROWS, materialise, tasks

_TASK = "concat('Fill form ', cast(page_id AS {s}))"


def plans(spark, sf_dir) -> DataFrame:
    return L.page_plans(D.form_elements(spark, sf_dir), ["page_id"], 800.0, F.expr(_TASK.format(s="string")))



_SUBMIT = Q.rx(fixed.SUBMIT_WORDS, True)
_TXT = f"(tag = 'textarea' OR (tag = 'input' AND lower(coalesce(type, '')) IN {Q._in(fixed.TEXTUAL_TYPES_AUDIT)}))"
_PLAN = f"""fields0 AS (
    SELECT *, row_number() OVER (PARTITION BY page_id, coalesce(selector, '') ORDER BY y, x, pos) AS rn FROM audited
    WHERE visible AND {_TXT} AND (field_kind IS NOT NULL OR regexp_matches(actx, {Q.rx(fixed.AUDIT_CAPTCHA, True)}))),
fields AS (SELECT * FROM fields0 WHERE rn = 1),
controls AS (
    SELECT *, (regexp_matches(coalesce(text, ''), {_SUBMIT}) OR regexp_matches(coalesce(type, ''), {_SUBMIT})
               OR regexp_matches(coalesce(label, ''), {_SUBMIT})) AS named
    FROM audited WHERE visible AND (tag = 'button' OR (tag = 'input' AND lower(coalesce(type, '')) IN ('submit', 'button'))
               OR coalesce(role, '') = 'button')),
submits AS (
    SELECT page_id, coalesce(min(pos) FILTER (WHERE named), max(pos)) AS pos FROM controls GROUP BY page_id),
submit AS (SELECT c.* FROM controls c JOIN submits USING (page_id, pos)),
pages AS (
    SELECT page_id, coalesce(bool_or(visible AND {_TXT} AND trim(coalesce(value, '')) = ''), false) AS has_empty
    FROM audited GROUP BY page_id),
page_fields AS (
    SELECT p.page_id, (SELECT count(*) FROM fields f WHERE f.page_id = p.page_id) AS n_fields,
           coalesce((SELECT bool_or(y + h > 680) FROM fields f WHERE f.page_id = p.page_id), false)
           OR coalesce((SELECT y + h > 680 FROM submit s WHERE s.page_id = p.page_id), false) AS below,
           (SELECT count(*) FROM submit s WHERE s.page_id = p.page_id) > 0 AS has_submit
    FROM pages p),
acts AS (
    SELECT page_id, 0 AS phase, 0 AS y, 0 AS x, 0 AS pos, 'scroll' AS action, '' AS selector, NULL AS value, 'down' AS direction,
           480 AS distance, '{fixed.PLAN_TEXT['scroll']}' AS reasoning, 0.90::DOUBLE AS confidence FROM page_fields WHERE below
    UNION ALL
    SELECT page_id, 1, y, x, pos, 'type', selector, fill, NULL, NULL,
           concat('Filling ', coalesce(field_kind, 'field'), ' ''', substr(coalesce(nullif(label, ''), selector), 1, 32), ''' ',
                  CASE WHEN fill LIKE '[%' THEN '(token resolved client-side).' ELSE '.' END), 0.92::DOUBLE FROM fields
    UNION ALL
    SELECT page_id, 2, 0, 0, pos, 'click', selector, NULL, NULL, NULL,
           concat('Activating primary control ''', substr(coalesce(nullif(text, ''), nullif(label, ''), selector), 1, 32), '''.'),
           0.90::DOUBLE FROM submit
    UNION ALL
    SELECT page_id, 3, 0, 0, 0, 'finish', '', NULL, NULL, NULL,
           concat('Task ''', substr({_TASK.format(s='varchar')}, 1, 60), ''' plan executed (', n_fields, ' fields, submit=',
                  CASE WHEN has_submit THEN 'yes' ELSE 'no' END, ').'), 0.95::DOUBLE FROM page_fields),
plan AS (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY phase, y, x, pos) - 1 AS step FROM acts)"""


@query(
    "action_plan",
    Q.with_ctes(
        Q.FORM, Q.AUDIT_KINDS, _PLAN,
        select="SELECT page_id, step, action, selector, value, direction, distance, reasoning, confidence FROM plan",
    ),
)
def action_plan(spark, sf_dir):
    return L.plan_rows(plans(spark, sf_dir), "page_id")


_SUMMARY = f"""lines AS (
    SELECT page_id, pos, concat('  ', concat_ws(' ', tag, coalesce(selector, ''), 'type=' || nullif(type, ''),
           'label=' || nullif(substr(label, 1, 40), ''), 'ac=' || nullif(autocomplete, ''),
           'value=' || nullif(substr(value, 1, 24), ''), concat('at=(', x, ',', y, ')'))) AS line
    FROM form_elements WHERE pos < {fixed.SUMMARY_LINES}),
summaries AS (SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS summary FROM lines GROUP BY page_id)"""


_SOME_FORM = f"form_elements AS (SELECT * FROM ({D.form_elements_sql()}) WHERE page_id % 7 <> 0)"
_HEIGHT = "(600 + page_id % 3 * 200)"
_ALL_PLANS = (
    _PLAN.replace("y + h > 680", f"y + h > {_HEIGHT.replace('page_id', '{page}')} * 0.85").replace("480 AS distance", f"CAST(floor({_HEIGHT} * 0.6) AS INTEGER) AS distance")
    .replace("FROM audited GROUP BY page_id),", "FROM audited GROUP BY page_id UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey % 7 = 0),")
).replace("{page}", "p.page_id")


@query(
    "plan_all_pages",
    Q.with_ctes(
        _SOME_FORM, Q.AUDIT_KINDS, _ALL_PLANS,
        select="SELECT page_id, step, action, selector, value, direction, distance, reasoning, confidence FROM plan",
    ),
)
def plan_all_pages(spark, sf_dir):
    """Plans with each page's own viewport, and one for every page without elements."""
    elements = D.form_elements(spark, sf_dir).where(F.col("page_id") % 7 != 0)
    pages = D.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    tall = E.on_all_pages(elements, pages, "page_id").withColumn("viewport_height", (F.col("page_id") % 3 * 200 + 600).cast("double"))
    return L.plan_rows(L.page_plans(tall, ["page_id"], "viewport_height", F.expr(_TASK.format(s="string"))), "page_id")


@query(
    "summary_all_pages",
    Q.with_ctes(
        _SOME_FORM, _SUMMARY,
        select=f"""SELECT c_custkey AS page_id, md5(coalesce(summary, '{fixed.EMPTY_SUMMARY}')) AS summary_md5, n_elements
        FROM customer c LEFT JOIN summaries s ON s.page_id = c.c_custkey
        LEFT JOIN LATERAL (SELECT count(*) AS n_elements FROM form_elements f WHERE f.page_id = c.c_custkey) ON true""",
    ),
)
def summary_all_pages(spark, sf_dir):
    """Page summaries and sizes of payloads, for pages without elements too."""
    elements = D.form_elements(spark, sf_dir).where(F.col("page_id") % 7 != 0)
    pages = D.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    whole = materialise(E.on_all_pages(elements, pages, "page_id"), "all-pages")
    sized = W.payload_bodies(whole.withColumns({"session_id": F.lit(0), "step": F.lit(0)}), F.lit("t")).select(
        "page_id", F.size(F.from_json("body", "dom_elements array<struct<pos:int>>")["dom_elements"]).cast("long").alias("n_elements")
    )
    done = L.page_summary(whole, "page_id").join(sized, "page_id")
    return done.select("page_id", F.md5("summary").alias("summary_md5"), "n_elements")


@query(
    "find_submit",
    Q.with_ctes(
        Q.FORM, Q.AUDIT_KINDS, _PLAN,
        select="SELECT page_id, s.selector AS submit_selector, below AS below_fold FROM page_fields LEFT JOIN submit s USING (page_id)",
    ),
)
def find_submit(spark, sf_dir):
    click = F.filter("plan", lambda a: a["action"] == "click")
    return plans(spark, sf_dir).select(
        "page_id",
        F.try_element_at(click, F.lit(1))["selector"].alias("submit_selector"),
        (F.element_at("plan", 1)["action"] == "scroll").alias("below_fold"),
    )


@query(
    "plan_step",
    Q.with_ctes(
        Q.FORM, Q.AUDIT_KINDS, _PLAN,
        """calls AS (SELECT o_orderkey AS call_id, o_custkey AS page_id, o_orderkey % 25 AS n FROM orders)""",
        """sizes AS (SELECT page_id, count(*) AS len FROM plan GROUP BY page_id)""",
        select=f"""SELECT call_id, c.page_id, n, coalesce(p.action, 'finish') AS action, coalesce(p.selector, '') AS selector, p.value,
        coalesce(p.reasoning, '{fixed.PLAN_TEXT['idle']}') AS reasoning, coalesce(p.confidence, 0.90::DOUBLE) AS confidence
        FROM calls c JOIN sizes USING (page_id) JOIN pages g USING (page_id)
        LEFT JOIN plan p ON p.page_id = c.page_id AND p.step = n % len AND (n < len OR has_empty)""",
    ),
)
def plan_step(spark, sf_dir):
    calls = D.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 25).alias("n")
    )
    return L.answer_calls(calls, plans(spark, sf_dir), ["page_id"], "n")


@query("page_summary", Q.with_ctes(Q.FORM, _SUMMARY, select="SELECT page_id, md5(summary) AS summary_md5, length(summary) AS n FROM summaries"))
def page_summary(spark, sf_dir):
    done = L.page_summary(D.form_elements(spark, sf_dir), "page_id")
    return done.select("page_id", F.md5("summary").alias("summary_md5"), F.length("summary").alias("n"))


@query(
    "prompt_text",
    Q.with_ctes(
        Q.FORM, _SUMMARY,
        select=f"""SELECT page_id, md5(concat('TASK: ', {_TASK.format(s='varchar')}, chr(10), 'URL: ',
        CASE WHEN page_id % 3 = 0 THEN '(unknown)' ELSE concat('https://example.com/f/', page_id) END, chr(10),
        'STEP: ', page_id % 8, chr(10), 'VIEWPORT: 1280x800', chr(10),
        'DOM SUMMARY (sanitized, values are tokens):', chr(10), summary, chr(10), chr(10),
        'Decide the single next action. Respond with the JSON object only.')) AS prompt_md5 FROM summaries""",
    ),
)
def prompt_text(spark, sf_dir):
    done = L.page_summary(D.form_elements(spark, sf_dir), "page_id")
    k = F.col("page_id")
    url = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://example.com/f/"), k.cast("string")))
    text = L.prompt(
        F.expr(_TASK.format(s="string")), url, k % 8, F.lit(fixed.DEFAULT_VIEWPORT[0]), F.lit(fixed.DEFAULT_VIEWPORT[1]),
        F.col("summary"),
    )
    return done.select("page_id", F.md5(text).alias("prompt_md5"))


_PAGE_ACTIONS = """page_actions AS (
    SELECT page_id, pos AS action_id, CASE (page_id + pos) % 5 WHEN 0 THEN selector WHEN 1 THEN concat('#', id)
           WHEN 2 THEN coalesce(name, '"missing"') WHEN 3 THEN concat('text= ', upper(coalesce(text, 'nothing')), ' ')
           ELSE concat('#gone', pos) END AS selector FROM form_elements)"""


def page_actions(elements: DataFrame) -> DataFrame:
    turn = (F.col("page_id") + F.col("pos")) % 5
    selector = (
        F.when(turn == 0, F.col("selector"))
        .when(turn == 1, F.concat(F.lit("#"), "id"))
        .when(turn == 2, F.coalesce("name", F.lit('"missing"')))
        .when(turn == 3, F.concat(F.lit("text= "), F.upper(F.coalesce("text", F.lit("nothing"))), F.lit(" ")))
        .otherwise(F.concat(F.lit("#gone"), F.col("pos").cast("string")))
    )
    return elements.select("page_id", F.col("pos").alias("action_id"), selector.alias("selector"))


@query(
    "action_targets",
    Q.with_ctes(
        Q.FORM, _PAGE_ACTIONS,
        r"""hits AS (
        SELECT a.page_id, a.action_id,
               (SELECT min(pos) FROM form_elements e WHERE e.page_id = a.page_id AND e.selector = a.selector) AS p1,
               (SELECT min(pos) FROM form_elements e WHERE e.page_id = a.page_id AND '#' || e.id = a.selector) AS p2,
               (SELECT min(pos) FROM form_elements e WHERE e.page_id = a.page_id
                    AND e.name = replace(replace(a.selector, '"', ''), '\', '')) AS p3,
               (SELECT min(pos) FROM form_elements e WHERE e.page_id = a.page_id AND a.selector LIKE 'text=%'
                    AND (tag IN ('button', 'a') OR (tag = 'input' AND type = 'submit') OR role = 'button')
                    AND lower(trim(coalesce(nullif(e.text, ''), e.value, ''))) = lower(trim(substr(a.selector, 6)))) AS p4,
               regexp_matches(a.selector, '^#[\w-]+$') AS id_form
        FROM page_actions a)""",
        select="""SELECT page_id, action_id, CASE WHEN p1 IS NOT NULL THEN 'selector' WHEN id_form THEN
            CASE WHEN p2 IS NOT NULL THEN 'id' END WHEN p3 IS NOT NULL THEN 'name' WHEN p4 IS NOT NULL THEN 'text' END AS way,
            CASE WHEN p1 IS NOT NULL THEN p1 WHEN id_form THEN p2 ELSE coalesce(p3, p4) END AS target_pos FROM hits""",
    ),
)
def action_targets(spark, sf_dir):
    elements = D.form_elements(spark, sf_dir)
    n = tasks(D.load(spark, sf_dir, "customer"), WORK_ROWS)
    return L.action_targets(page_actions(elements), elements, ["page_id"], "action_id", tasks=n).drop("selector")


@query(
    "dangling_actions",
    Q.with_ctes(
        Q.FORM, _PAGE_ACTIONS,
        select="""SELECT page_id, action_id, selector FROM page_actions a WHERE coalesce(selector, '') <> ''
        AND NOT EXISTS (SELECT 1 FROM form_elements e WHERE e.page_id = a.page_id AND e.selector = a.selector)""",
    ),
)
def dangling_actions(spark, sf_dir):
    elements = D.form_elements(spark, sf_dir)
    return L.dangling(page_actions(elements), elements, "page_id").select("page_id", "action_id", "selector")


_WIDE_FIELDS = ("otp", "captcha", "fullname", "phone", "card", "expiry", "cvv", "address", "dob", "idnum")
_WIDE_SQL = f"""wide AS (
    SELECT page_id, template, {', '.join(f"max(value) FILTER (WHERE id = '{c}') AS {c}" for c in _WIDE_FIELDS)},
           page_id % 5 <> 0 AS consent
    FROM form_elements WHERE template < 3 GROUP BY page_id, template)"""


@query(
    "form_validation",
    Q.with_ctes(
        Q.FORM, _WIDE_SQL,
        select=rf"""SELECT page_id, list_aggregate(errs, 'string_agg', ' ') IS NULL AS valid,
            coalesce(list_aggregate(errs, 'string_agg', ' '), '') AS errors
        FROM (SELECT page_id, list_filter(CASE template
            WHEN 0 THEN [CASE WHEN NOT regexp_matches(trim(otp), '^\d{{6}}$') THEN 'OTP must be 6 digits.' END,
                         CASE WHEN trim(captcha) <> 'A7X3' THEN 'Captcha does not match.' END]
            WHEN 1 THEN [CASE WHEN trim(fullname) = '' THEN 'Full name is required.' END,
                         CASE WHEN NOT regexp_matches(trim(phone), '^\+?\d[\d -]{{8,14}}$') THEN 'Mobile number looks invalid.' END,
                         CASE WHEN NOT {Q.luhn('card')} THEN 'Card number failed the Luhn check.' END,
                         CASE WHEN NOT regexp_matches(trim(expiry), '^(0[1-9]|1[0-2])/\d{{2}}$') THEN 'Expiry must be MM/YY.' END,
                         CASE WHEN NOT regexp_matches(trim(cvv), '^\d{{3,4}}$') THEN 'CVV must be 3–4 digits.' END,
                         CASE WHEN trim(address) = '' THEN 'Street address is required.' END]
            ELSE [CASE WHEN length(trim(fullname)) < 3 THEN 'Enter your full name as printed on the ID.' END,
                  CASE WHEN coalesce(dob, '') = '' THEN 'Date of birth is required.' END,
                  CASE WHEN NOT regexp_matches(regexp_replace(idnum, '[ ]', '', 'g'), '^\d{{12}}$|^\d{{3}}-\d{{2}}-\d{{4}}$|^[A-Z]{{5}}\d{{4}}[A-Z]$')
                       THEN 'ID number format is not recognised.' END,
                  CASE WHEN trim(address) = '' THEN 'Residential address is required.' END,
                  CASE WHEN NOT consent THEN 'Consent is required to submit.' END] END, lambda er: er IS NOT NULL) AS errs
            FROM wide)""",
    ),
)
def form_validation(spark, sf_dir):
    elements = D.form_elements(spark, sf_dir).filter("template < 3")
    wide = (
        elements.groupBy("page_id", "template")
        .agg(*[F.max(F.when(F.col("id") == c, F.col("value"))).alias(c) for c in _WIDE_FIELDS])
        .withColumn("consent", F.col("page_id") % 5 != 0)
        .withColumn("form", F.element_at(F.array(F.lit("login"), F.lit("checkout"), F.lit("kyc")), F.col("template") + 1))
    )
    return K.form_errors(wide).select("page_id", "valid", F.array_join("errors", " ").alias("errors"))




def _template_provider():
    """Stand-in for a remote model: answers from the text of the prompt alone."""
    def answer(prompts: list[str]) -> list[str]:
        return [
            '```json\n{"action": "click", "selector": "#n%d", "confidence": 0.5}\n```' % len(p) if len(p) % 3 else "no idea"
            for p in prompts
        ]

    return answer


@query(
    "provider_actions",
    Q.with_ctes(
        Q.FORM, _SUMMARY,
        select="""SELECT page_id, CASE WHEN length(summary) % 3 <> 0 THEN 'click' END AS action,
        CASE WHEN length(summary) % 3 <> 0 THEN concat('#n', length(summary)) END AS selector,
        CASE WHEN length(summary) % 3 = 0 THEN 'no JSON' END AS error FROM summaries""",
    ),
)
def provider_actions(spark, sf_dir):
    summaries = L.page_summary(D.form_elements(spark, sf_dir), "page_id")
    done = R.provider_actions(summaries, "summary", _template_provider, "page_id")
    return done.select("page_id", "action", "selector", "error")
