"""Relations derived from the given tables by plain arithmetic.

The tables hold no forms, images or payloads.  These builders make them from
keys, so that every query on them grows with the data.  ``*_sql`` functions give
the same relation for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import geometry as G
from veilspark.session import WORK_ROWS, spread

TEMPLATES = 4
STEPS_PER_SESSION = 8
TEMPLATE_DDL = (
    "template int, pos int, tag string, type string, id string, name string, classes string, selector string, "
    "text string, label string, placeholder string, aria_label string, autocomplete string, role string, "
    "rule string, is_img boolean, img_hints string, alt string, visible boolean, "
    "x int, y int, w int, h int, gt_class string"
)


def _row(template, pos, tag, type_, id_, rect, *, rule=None, label=None, text=None, placeholder=None, aria=None,
         auto=None, role=None, name=None, classes=None, selector=None, img=False, hints=None, alt=None,
         visible=True, gt=None):
    return (
        template, pos, tag, type_, id_, name, classes, selector or f"#{id_}", text, label, placeholder, aria, auto,
        role, rule, img, hints, alt, visible, *rect, gt,
    )


# fixed values: form pages as the element tables of four templates
FORM_TEMPLATE = (
    _row(0, 0, "input", "email", "email", (364, 172, 552, 30), rule="email", label="Email or username",
         placeholder="name@company.com", auto="email", gt="email"),
    _row(0, 1, "input", "password", "password", (364, 250, 552, 30), rule="password", label="Password",
         auto="current-password", gt="password"),
    _row(0, 2, "input", "text", "otp", (364, 328, 552, 30), rule="empty", label="OTP code",
         auto="one-time-code", gt="otp"),
    _row(0, 3, "input", "text", "captcha", (510, 406, 406, 30), rule="empty", label="Captcha code", auto="off"),
    _row(0, 4, "input", "checkbox", "remember", (364, 476, 18, 18), label="Keep me signed in on this device"),
    _row(0, 5, "button", "submit", "submit-btn", (364, 526, 552, 44), text="Sign in"),
    _row(0, 6, "input", "text", "internal-ref", (0, 0, 0, 0), rule="ref", label="Internal ref", visible=False),
    _row(1, 0, "input", "text", "fullname", (364, 132, 552, 30), rule="name", label="Full name", auto="name",
         gt="name"),
    _row(1, 1, "input", "tel", "phone", (364, 210, 552, 30), rule="phone", label="Mobile number", auto="tel",
         gt="phone"),
    _row(1, 2, "textarea", None, "address", (364, 288, 552, 58), rule="address", label="Street address",
         auto="street-address", gt="address"),
    _row(1, 3, "input", "text", "city", (364, 378, 262, 30), rule="city", label="City", auto="address-level2",
         gt="address"),
    _row(1, 4, "input", "text", "zip", (642, 378, 262, 30), rule="zip", label="PIN code", auto="postal-code",
         gt="address"),
    _row(1, 5, "input", "text", "card", (364, 456, 552, 30), rule="card", label="Card number", auto="cc-number",
         gt="credit_card"),
    _row(1, 6, "input", "text", "expiry", (364, 534, 262, 30), rule="expiry", label="Expiry", auto="cc-exp",
         gt="expiry"),
    _row(1, 7, "input", "text", "cvv", (642, 534, 262, 30), rule="cvv", label="CVV", auto="cc-csc", gt="cvv"),
    _row(1, 8, "input", "text", "orderref", (364, 612, 552, 30), rule="order", label="Order reference (for support)"),
    _row(1, 9, "button", "submit", "submit-btn", (364, 690, 552, 44), text="Place order"),
    _row(1, 10, "input", "text", "promo-cache", (0, 0, 0, 0), rule="hidden", label="Promo cache", visible=False),
    _row(2, 0, "img", None, "photo", (364, 134, 160, 160), classes="profile-photo", selector=".profile-photo",
         img=True, hints="photo profile-photo avatar", alt="Applicant photo", gt="photo"),
    _row(2, 1, "input", "text", "fullname", (556, 132, 360, 30), rule="name", label="Full name (as per ID)",
         auto="name", gt="name"),
    _row(2, 2, "input", "date", "dob", (556, 210, 360, 30), rule="dob", label="Date of birth", gt="dob"),
    _row(2, 3, "select", None, "idtype", (556, 288, 360, 30), rule="idtype", label="ID document type"),
    _row(2, 4, "input", "text", "idnum", (364, 352, 552, 30), rule="idnum", label="Government ID number",
         gt="national_id"),
    _row(2, 5, "textarea", None, "address", (364, 430, 552, 58), rule="address", label="Residential address",
         auto="street-address", gt="address"),
    _row(2, 6, "input", "text", "income", (364, 532, 552, 30), rule="income", label="Annual income (optional)",
         gt="sensitive"),
    _row(2, 7, "input", "checkbox", "consent", (364, 590, 18, 18),
         label="I confirm the photo and details above are mine"),
    _row(2, 8, "button", "submit", "submit-btn", (364, 640, 552, 44), text="Submit for verification"),
    _row(2, 9, "input", "text", "audit-ref", (0, 0, 0, 0), rule="ref", label="Audit ref", visible=False),
    _row(3, 0, "a", None, "home", (20, 20, 80, 20), text="Home", role="link", classes="nav top"),
    _row(3, 1, "img", None, "logo", (120, 20, 90, 30), img=True, hints="logo", alt="Shop logo"),
    _row(3, 2, "input", "text", "holder", (364, 120, 552, 30), rule="name", placeholder="As printed", auto="cc-name",
         name="holder", gt="name"),
    _row(3, 3, "input", "text", "work", (364, 180, 552, 30), rule="email", aria="Work e-mail", name="work",
         gt="email"),
    _row(3, 4, "input", "search", "contact", (364, 240, 552, 30), rule="phone", label="WhatsApp", gt="phone"),
    _row(3, 5, "input", "text", "tax", (364, 300, 552, 30), rule="ssn", label="Social Security number", gt="ssn"),
    _row(3, 6, "input", "text", "bank", (364, 360, 552, 30), rule="idnum", label="Bank account no",
         gt="account_number"),
    _row(3, 7, "input", "text", "apikey", (364, 420, 552, 30), rule="ref", label="Access token", gt="sensitive"),
    _row(3, 8, "input", "text", "tokname", (364, 480, 552, 30), rule="ref", label="Token display name"),
    _row(3, 9, "input", "file", "upload", (364, 540, 552, 30), rule="email", label="Attachment"),
    _row(3, 10, "div", None, "more", (364, 720, 200, 30), text="Continue", role="button"),
    _row(3, 11, "input", "text", "remarks", (364, 600, 552, 30), rule="remark", label="Remarks", name="remarks"),
    _row(3, 12, "input", "text", "remarks2", (364, 640, 552, 30), rule="remark", label="Remarks again",
         selector="#remarks"),
    _row(3, 13, "input", "number", "bday", (364, 660, 100, 20), rule="dob", name="born on", selector="",
         gt="dob"),
)

# (rule, SQL expression over k = customer key and c_name) - same text runs on both engines


def _digit(i: int) -> str:
    return f"(cast(floor(k / {10 ** i}) AS bigint) % 10)"


def _check_digit() -> str:
    """Luhn check digit of '4000000' followed by the key in eight digits."""
    terms = ["8"]
    for i in range(8):
        d = _digit(i)
        terms.append(f"(2 * {d} - 9 * (CASE WHEN {d} > 4 THEN 1 ELSE 0 END))" if i % 2 == 0 else d)
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def value_rules(string: str = "string", page: bool = False) -> list[tuple[str, str]]:
    """``page``: the columns of ``_PAGE_VALUES`` are there already."""
    def s(e: str) -> str:
        return f"cast({e} AS {string})"

    def pad(e: str, n: int) -> str:
        return f"lpad({s(e)}, {n}, '0')"

    pad8, check = ("pad8", "check") if page else (pad("k", 8), _check_digit())
    card = (
        f"concat('4000 000', substr({pad8}, 1, 1), ' ', substr({pad8}, 2, 4), ' ', substr({pad8}, 6, 3), "
        f"{s(f'({check} + k % 2) % 10')})"
    )
    order = f"concat('4000000', {pad8}, {s(f'({check} + CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END) % 10')})"
    email = "email" if page else f"concat('user', {s('k')}, '@mail', {s('k % 10')}, '.example.com')"
    return [
        ("email", f"CASE WHEN k % 11 = 0 THEN '' ELSE {email} END"),
        ("password", f"CASE WHEN k % 13 = 0 THEN concat('a\"', {s('k')}, '!') ELSE concat('Pw#', {s('k')}, 'x!') END"),
        ("empty", "''"),
        ("ref", f"concat('R-', {s('k')})"),
        ("name", "c_name"),
        ("phone", f"concat('+91 98765 4', {pad('k % 10000', 4)})"),
        ("address", f"concat({s('k')}, ' Hill Road')"),
        ("city", "'Springfield'"),
        ("zip", pad("k % 1000000", 6)),
        ("card", card),
        ("expiry", f"concat({pad('1 + k % 12', 2)}, '/', {s('25 + k % 6')})"),
        ("cvv", pad("k % 1000", 3)),
        ("order", order),
        ("hidden", f"CASE WHEN k % 3 = 0 THEN {email} ELSE 'PROMO' END"),
        ("dob", f"concat('19', {s('50 + k % 50')}, '-0', {s('1 + k % 9')}, '-1', {s('k % 10')})"),
        ("idtype", "'Passport'"),
        ("idnum", f"concat('2345 6789 ', {pad('k % 10000', 4)})"),
        ("income", s("k * 1000")),
        ("ssn", f"concat({pad('k % 900', 3)}, '-12-', {pad('k % 10000', 4)})"),
        ("remark", f"CASE WHEN k % 6 = 0 THEN concat('write to ', {email}) ELSE 'none' END"),
    ]


def value_case(string: str = "string", page: bool = False) -> str:
    arms = " ".join(f"WHEN '{rule}' THEN {expr}" for rule, expr in value_rules(string, page))
    return f"CASE rule {arms} END"


# what several rules read, made once a page and not once an element
_PAGE_VALUES = {
    "pad8": "lpad(cast(k AS string), 8, '0')",
    "check": _check_digit(),
    "email": "concat('user', cast(k AS string), '@mail', cast(k % 10 AS string), '.example.com')",
}

VISIBLE_RULE = "visible AND NOT (k % 9 = 0 AND pos = 2)"


def template_rows(spark: SparkSession) -> DataFrame:
    """The fixed rows as an inline table, part of the plan itself."""
    return spark.sql(template_sql(dict(int="INT", string="STRING", boolean="BOOLEAN")))


def template_sql(type_names: dict[str, str]) -> str:
    columns = [c.split() for c in TEMPLATE_DDL.split(", ")]
    rows = ",\n".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in FORM_TEMPLATE)
    casts = ", ".join(f"CAST({n} AS {type_names[t]}) AS {n}" for n, t in columns)
    return f"SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(n for n, _ in columns)})"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def form_elements(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """Element rows of one form page per customer; eight pages make a session. ``customers`` may be a stream."""
    if customers is None:
        customers = spread(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", rows=WORK_ROWS)
    customers = customers.select(
        F.col("c_custkey").alias("k"), "c_name", (F.col("c_custkey") % TEMPLATES).cast("int").alias("template")
    )
    customers = customers.withColumns({name: F.expr(made) for name, made in _PAGE_VALUES.items()})
    template = template_rows(spark).select(  # fixed size: the rows above
        "*",
        F.when(F.col("classes").isNull(), F.array().cast("array<string>")).otherwise(F.split("classes", " ")).alias("class_list"),
        G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("rect"),
    )
    return (
        customers.join(F.broadcast(template), "template")
        .withColumn("value", F.expr(value_case(page=True)))
        .withColumn("visible", F.expr(VISIBLE_RULE))
        .select(
            F.col("k").alias("page_id"),
            F.floor(F.col("k") / STEPS_PER_SESSION).alias("session_id"),
            (F.col("k") % STEPS_PER_SESSION).cast("int").alias("step"),
            "template", "pos", "tag", "type", "id", "name",
            F.col("class_list").alias("classes"),
            "selector", "text", "label", "placeholder", "aria_label", "autocomplete", "role", "value",
            "is_img", "img_hints", "alt", "visible",
            "rect",
            "gt_class",
        )
    )


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def form_elements_sql() -> str:
    """CTE body with the same rows; classes joined by a blank, box flat."""
    template = template_sql(dict(int="INTEGER", string="VARCHAR", boolean="BOOLEAN"))
    return f"""
    SELECT k AS page_id, k // {STEPS_PER_SESSION} AS session_id, CAST(k % {STEPS_PER_SESSION} AS INTEGER) AS step,
           t.* EXCLUDE (rule, visible), {value_case('varchar')} AS value, ({VISIBLE_RULE}) AS visible
    FROM (SELECT c_custkey AS k, c_name FROM customer) c
    JOIN ({template}) t ON t.template = c.k % {TEMPLATES}
    """


# ---------------------------------------------------------------------------
# labels, boxes
# ---------------------------------------------------------------------------
def form_labels(elements: DataFrame) -> DataFrame:
    """Label elements: most labelled fields have one, some have an earlier empty one."""
    fields = elements.filter(F.col("label").isNotNull() & (F.col("page_id") % 5 != 0))
    main = fields.select("page_id", F.col("id").alias("for_id"), F.col("pos"), F.concat(F.lit(" "), "label").alias("text"))
    blank = fields.filter(F.col("page_id") % 7 == 0).select(
        "page_id", F.col("id").alias("for_id"), (F.col("pos") - 100).alias("pos"), F.lit("  ").alias("text")
    )
    return main.unionByName(blank)


FORM_LABELS_SQL = """
    SELECT page_id, id AS for_id, pos, concat(' ', label) AS text FROM form_elements
    WHERE label IS NOT NULL AND page_id % 5 <> 0
    UNION ALL
    SELECT page_id, id, pos - 100, '  ' FROM form_elements
    WHERE label IS NOT NULL AND page_id % 5 <> 0 AND page_id % 7 = 0
"""


def shifted(elements: DataFrame) -> DataFrame:
    """Detector boxes: sensitive visible elements moved by (key % 7) - 3 px,
    a second overlapping box for some, none for others."""
    dx = ((F.col("page_id") + F.col("pos")) % 7 - 3).cast("double")
    r = F.col("rect")
    base = elements.filter(F.col("gt_class").isNotNull() & F.col("visible") & (F.col("rect.width") > 0))
    first = base.filter((F.col("page_id") + F.col("pos")) % 17 != 0).select(
        "page_id", (F.col("pos") * 2).alias("pos"), "selector", F.col("gt_class").alias("pii_type"),
        G.box(r["x"] + dx, r["y"] + dx, r["width"], r["height"]).alias("box"),
        (F.lit(0.5) + (F.col("page_id") % 5) / 10.0).alias("confidence"),
    )
    second = base.filter((F.col("page_id") % 3 == 0) & (F.col("pos") % 2 == 0)).select(
        "page_id", (F.col("pos") * 2 + 1).alias("pos"), F.lit(None).cast("string").alias("selector"),
        F.lit("face").alias("pii_type"),
        G.box(r["x"] + 20, r["y"] + 5, r["width"] - 60, r["height"] + 40).alias("box"),
        (F.lit(0.5) + (F.col("page_id") % 4) / 10.0).alias("confidence"),
    )
    return first.unionByName(second)


SHIFTED_SQL = """
    SELECT page_id, pos * 2 AS pos, selector, gt_class AS pii_type,
           CAST(x + (page_id + pos) % 7 - 3 AS DOUBLE) AS x, CAST(y + (page_id + pos) % 7 - 3 AS DOUBLE) AS y,
           CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, 0.5::DOUBLE + (page_id % 5) / 10.0::DOUBLE AS confidence
    FROM form_elements WHERE gt_class IS NOT NULL AND visible AND w > 0 AND (page_id + pos) % 17 <> 0
    UNION ALL
    SELECT page_id, pos * 2 + 1, NULL, 'face', x + 20, y + 5, w - 60, h + 40,
           0.5::DOUBLE + (page_id % 4) / 10.0::DOUBLE
    FROM form_elements WHERE gt_class IS NOT NULL AND visible AND w > 0 AND page_id % 3 = 0 AND pos % 2 = 0
"""


def default_values(spark: SparkSession) -> DataFrame:
    """Fallback values, one per token kind (fixed size)."""
    return spark.sql(default_values_sql())


# fixed values: synthetic fallbacks, in lookup order
DEFAULT_VALUES = (
    (1, "USER_PASSWORD_1", "Sample#Pass1"),
    (2, "USER_EMAIL_1", "sample.user@example.com"),
    (3, "USER_PHONE_1", "+91 90000 00000"),
    (4, "CARD_NUMBER_1", "4000 0000 0000 0002"),
    (5, "ACCOUNT_NUMBER_1", "100200300400"),
    (6, "CVV_1", "999"),
    (7, "EXPIRY_1", "01/30"),
    (8, "USER_OTP_1", "000000"),
    (9, "NATIONAL_ID_1", "1111 2222 3333"),
    (10, "DOB_1", "1990-01-01"),
    (11, "USER_NAME_1", "Sample User"),
    (12, "ADDRESS_1", "1 Sample Street"),
)


def default_values_sql() -> str:
    return "SELECT ord, token_name, raw_value FROM (VALUES " + ", ".join(
        f"({o}, '{n}', '{v}')" for o, n, v in DEFAULT_VALUES
    ) + ") AS d(ord, token_name, raw_value)"


def telemetry(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One row per step: stage timings in ms from the event value and id. ``events`` may be a stream."""
    e = spread(load(spark, sf_dir, "events"), "event_id") if events is None else events
    ms = F.col("value")
    return e.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 16).cast("int").alias("step"),
        (ms * 2).alias("capture_ms"),
        (ms * 1.5).alias("dom_ms"),
        (ms * 3).alias("perception_ms"),
        (ms * 2.5).alias("redaction_ms"),
        (ms * 6).alias("network_ms"),
        F.when(F.col("event_id") % 3 != 0, ms * 4).alias("exec_ms"),
        "event_type",
    )


TELEMETRY_SQL = """
    SELECT user_id AS session_id, event_id, ts, CAST(event_id % 16 AS INTEGER) AS step,
           value * 2 AS capture_ms, value * 1.5::DOUBLE AS dom_ms, value * 3 AS perception_ms,
           value * 2.5::DOUBLE AS redaction_ms, value * 6 AS network_ms,
           CASE WHEN event_id % 3 <> 0 THEN value * 4 END AS exec_ms, event_type
    FROM events
"""


