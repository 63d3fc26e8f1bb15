"""Building blocks of the check SQL (DuckDB dialect)."""

from __future__ import annotations

from veilspark import fixed
from veilspark.plans import derived as D

WHITE_SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Contract pattern as an SQL string literal for RE2."""
    out = pattern.replace(r"[\s-]", f"[{WHITE_SPACE}-]").replace(r"\s", f"[{WHITE_SPACE}]")
    return "'" + ("(?i)" if ignore_case else "") + out.replace("'", "''") + "'"


PATTERN = {kind: rx(p) for kind, p in fixed.TEXT_PATTERNS}


def luhn(value: str) -> str:
    d = f"regexp_replace({value}, '[ -]', '', 'g')"
    digit = f"CAST(substr({d}, length({d}) - CAST(ix AS INTEGER), 1) AS INTEGER)"
    return (
        f"(length({d}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length({d})), lambda ix: "
        f"CASE WHEN ix % 2 = 1 THEN 2 * {digit} - 9 * ({digit} // 5) ELSE {digit} END)) % 10 = 0)"
    )


def found(kind: str, text: str) -> str:
    m = f"regexp_extract_all({text}, {PATTERN[kind]})"
    return f"list_filter({m}, lambda cand: {luhn('cand')})" if kind == "credit_card" else m


def scan(text: str) -> str:
    parts = [
        f"list_transform({found(k, text)}, lambda mtch: {{'type': '{k}', 'value': mtch}})" for k, _ in fixed.TEXT_PATTERNS
    ]
    return "(" + " || ".join(parts) + ")"


def findings(source: str, text: str, *keep: str) -> str:
    """(keep, pos, pii_type, value) rows of a relation."""
    cols = ", ".join(keep)
    return f"""
    SELECT {cols}, pos, f[pos + 1].type AS pii_type, f[pos + 1].value AS value
    FROM (SELECT {cols}, f, unnest(range(len(f))) AS pos FROM (SELECT {cols}, {scan(text)} AS f FROM {source}))
    """


def has_finding(text: str) -> str:
    return f"(len({scan(text)}) > 0)"


def redacted(text: str) -> str:
    """Nested replacement with the same order as the Spark job."""
    def token(k: str) -> str:
        return f"'[{fixed.TOKEN_KIND[k]}]'"

    mail_free = f"regexp_replace({text}, {PATTERN['email']}, {token('email')}, 'g')"
    return f"""
    (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        CASE WHEN cards = '' THEN m ELSE regexp_replace(m, cards, {token('credit_card')}, 'g') END,
        {PATTERN['phone']}, {token('phone')}, 'g'), {PATTERN['ssn']}, {token('ssn')}, 'g'),
        {PATTERN['national_id']}, {token('national_id')}, 'g'), {PATTERN['dob']}, {token('dob')}, 'g')
     FROM (SELECT m, CASE WHEN len(c) = 0 THEN '' ELSE concat('\\b(?:', list_aggregate(c, 'string_agg', '|'), ')\\b')
                     END AS cards
           FROM (SELECT m, list_transform(list_reverse_sort(list_distinct(list_transform({found('credit_card', 'm')},
                        lambda v: {{'n': length(regexp_replace(v, '[ -]+$', '')), 'v': regexp_replace(v, '[ -]+$', '')}}))),
                        lambda s: s.v) AS c
                 FROM (SELECT {mail_free} AS m))))
    """


def case_of(key: str, table: dict, quote: bool = True) -> str:
    arms = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if quote else str(v)) for k, v in table.items())
    return f"CASE {key} {arms} END"


def audit_hint(kind: str, value: str) -> str:
    arms = " ".join(
        f"WHEN '{k}' THEN concat(substr({value}, 1, {n}), '{'****' if k == 'credit_card' else '***'}')"
        for k, n in fixed.AUDIT_HINT_CHARS.items()
    )
    return f"CASE {kind} {arms} END"


FORM = f"form_elements AS ({D.form_elements_sql()})"


def text_ctx(*names: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({n}, '')" for n in names) + ")"


DETECTOR_CTX = text_ctx(
    "id", "name", "classes", "label", "placeholder", "aria_label", "autocomplete", "role", "selector"
)
IMAGE_CTX = text_ctx("id", "name", "classes", "alt", "aria_label", "selector", "img_hints")
AUDIT_CTX = text_ctx(
    "id", "name", "label", "placeholder", "aria_label", "autocomplete", "role", "selector", "text", "img_hints"
)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _keyword(pattern: str, column: str) -> tuple[str, str]:
    """(condition, matched word) of one keyword rule; RE2 has no look-ahead, so
    the one rule that needs it looks at the text after the last ``token``."""
    if "(?!" not in pattern:
        return f"regexp_matches({column}, {rx(pattern, True)})", f"regexp_extract({column}, {rx(pattern, True)})"
    plain = r"'(?i)\bsecret\b|api[" + WHITE_SPACE + r"-]?key'"
    tail = rf"regexp_extract({column}, '(?i)^.*\btoken\b(.*)$', 1)"
    token = rf"(regexp_matches({column}, '(?i)\btoken\b') AND NOT regexp_matches({tail}, '(?i)id|name'))"
    # leftmost of both alternatives
    word = (
        rf"CASE WHEN {token} AND (NOT regexp_matches({column}, {plain}) OR "
        rf"length(regexp_extract({column}, '(?i)^(.*?)\btoken\b', 1)) < "
        rf"length(regexp_extract({column}, '(?i)^(.*?)(?:\bsecret\b|api[ -]?key)', 1))) "
        rf"THEN regexp_extract({column}, '(?i)\btoken\b') ELSE regexp_extract({column}, {plain}) END"
    )
    return f"(regexp_matches({column}, {plain}) OR {token})", word


def detector_rules() -> str:
    """CASE giving struct(pii_type, confidence, evidence) from ctx, ty, auto, hits."""
    field = "tag IN ('input', 'textarea')"
    textual = f"(tag = 'textarea' OR (tag = 'input' AND ty IN {_in(fixed.TEXTUAL_TYPES_DETECTOR)}))"

    def hit(t, c, e):
        return f"{{'pii_type': {t}, 'confidence': CAST({c} AS DOUBLE), 'evidence': {e}}}"

    arms = [
        (f"{field} AND ty = 'password'", hit("'password'", 0.99, "'type=password'")),
        (f"{field} AND (ty = 'email' OR auto = 'email')", hit("'email'", 0.95, "'email field'")),
        (f"{field} AND (ty = 'tel' OR auto IN ('tel', 'mobile'))", hit("'phone'", 0.93, "'tel field'")),
        (f"{field} AND ty = 'date' AND regexp_matches(ctx, {rx(fixed.BIRTH_HINT, True)})",
         hit("'dob'", 0.93, "'date-of-birth field'")),
    ]
    for a, t in fixed.AUTOCOMPLETE_CLASS.items():
        arms.append((f"auto = '{a}'", hit(f"'{t}'", fixed.AUTOCOMPLETE_CONFIDENCE, f"'autocomplete={a}'")))
    arms.append(("auto = 'cc-name'", hit("'name'", 0.90, "'autocomplete=cc-name'")))
    arms.append(("auto = 'one-time-code'", hit("'otp'", 0.95, "'autocomplete=one-time-code'")))
    for _, p, t, c in fixed.KEYWORD_RULES:
        cond, word = _keyword(p, "ctx")
        arms.append((cond, hit(f"'{t}'", c, f"concat('context \"', {word}, '\"')")))
    for p, t, c in fixed.GATED_RULES:
        arms.append((f"{textual} AND regexp_matches(ctx, {rx(p, True)})", hit(f"'{t}'", c, f"'{t} context'")))
    arms.append(("len(list_filter(hits, lambda hh: hh.type = 'credit_card')) > 0",
                 hit("'credit_card'", 0.96, "'value pattern: credit_card'")))
    arms.append(("len(hits) > 0", hit("hits[1].type", 0.88, "concat('value pattern: ', hits[1].type)")))
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + " END"


CLASSIFIED = f"""classified AS (
    SELECT *, CASE WHEN det0 IS NULL THEN NULL
                   ELSE coalesce({case_of('det0.pii_type', fixed.REDACTION_MODE)}, '{fixed.DEFAULT_MODE}') END AS mode,
           CASE WHEN det0 IS NULL OR photo THEN NULL
                ELSE coalesce({case_of('det0.pii_type', fixed.TOKEN_KIND)}, '{fixed.DEFAULT_KIND}') END AS token_kind,
           det0.pii_type AS pii_type, det0.confidence AS confidence, det0.evidence AS evidence
    FROM (
        SELECT *, CASE WHEN NOT shown THEN NULL
                       WHEN photo THEN {{'pii_type': 'photo', 'confidence': CAST(0.80 AS DOUBLE),
                                        'evidence': concat('image region: ', substr(ictx, 1, 40))}}
                       ELSE {detector_rules()} END AS det0
        FROM (SELECT *, {DETECTOR_CTX} AS ctx, {IMAGE_CTX} AS ictx, lower(coalesce(type, '')) AS ty,
                     lower(coalesce(autocomplete, '')) AS auto,
                     {scan("CASE WHEN lower(coalesce(type, '')) = 'file' THEN '' ELSE coalesce(value, '') END")} AS hits,
                     (coalesce(visible, true) AND w >= 2 AND h >= 2) AS shown,
                     ((tag = 'img' OR is_img) AND regexp_matches({IMAGE_CTX}, {rx(fixed.PHOTO_WORDS, True)})) AS photo
              FROM form_elements)))"""

AUDIT_KIND = (
    "CASE WHEN tag IN ('input', 'textarea') AND lower(coalesce(type, '')) = 'password' THEN 'password' "
    "WHEN tag IN ('input', 'textarea') AND (lower(coalesce(type, '')) = 'email' "
    "OR lower(coalesce(autocomplete, '')) = 'email') THEN 'email' "
    "WHEN tag IN ('input', 'textarea') AND (lower(coalesce(type, '')) = 'tel' "
    "OR lower(coalesce(autocomplete, '')) IN ('tel', 'mobile')) THEN 'phone' "
    + " ".join(f"WHEN lower(coalesce(autocomplete, '')) = '{a}' THEN '{t}'" for a, t in fixed.AUTOCOMPLETE_CLASS.items())
    + " WHEN lower(coalesce(autocomplete, '')) = 'one-time-code' THEN 'otp' "
    + " ".join(f"WHEN regexp_matches(actx, {rx(p, True)}) THEN '{t}'" for _, p, t in fixed.AUDIT_KEYWORD_RULES)
    + f" WHEN regexp_matches(actx, {rx(fixed.AUDIT_EMAIL, True)}) THEN 'email'"
    + f" WHEN regexp_matches(actx, {rx(fixed.AUDIT_PHONE, True)}) THEN 'phone'"
    + f" WHEN regexp_matches(actx, {rx(fixed.AUDIT_NAME, True)}) AND tag IN ('input', 'textarea') THEN 'name'"
    + f" WHEN regexp_matches(actx, {rx(fixed.AUDIT_ADDRESS, True)}) THEN 'address' END"
)


def _fill() -> str:
    lit = fixed.FILL_LITERALS

    def m(p):
        return f"regexp_matches(actx, {rx(p, True)})"

    return (
        f"CASE WHEN {m(fixed.AUDIT_CAPTCHA)} THEN '{lit['captcha']}' WHEN {m(fixed.AUDIT_COUNTRY)} THEN "
        f"'{lit['country']}' WHEN {m(fixed.AUDIT_ID_TYPE)} THEN '{lit['id_type']}' "
        f"WHEN field_kind = 'address' AND {m(fixed.AUDIT_CITY)} THEN '{lit['city']}' "
        f"WHEN field_kind = 'address' AND {m(fixed.AUDIT_ZIP)} THEN '{lit['zip']}' "
        f"WHEN field_kind = 'address' AND {m(fixed.AUDIT_STATE)} THEN '{lit['state']}' "
        f"ELSE coalesce({case_of('field_kind', fixed.FILL_TOKEN)}, '{lit['other']}') END"
    )


AUDIT_KINDS = f"""audited AS (
    SELECT *, {_fill()} AS fill FROM (
        SELECT *, {AUDIT_KIND} AS field_kind FROM (SELECT *, {AUDIT_CTX} AS actx FROM form_elements)))"""

TOKENISED = f"""tagged AS (
    SELECT *, CASE WHEN coalesce(selector, '') = '' THEN NULL ELSE
        first_value(token_kind IGNORE NULLS) OVER (PARTITION BY page_id, selector ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS kind
    FROM classified),
tokenised AS (
    SELECT *, concat('[', kind, '_', seq, ']') AS token FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY step, page_id, pos) AS seq
        FROM tagged WHERE kind IS NOT NULL)),
vault AS (
    SELECT session_id, token, kind, seq, value AS raw_value FROM tokenised WHERE coalesce(value, '') <> ''),
sanitised AS (
    SELECT page_id, session_id, step, pos, tag, type, id, name, selector, text, label, aria_label, autocomplete, role,
           token AS value, is_img, img_hints, visible, x, y, w, h FROM tokenised
    UNION ALL
    SELECT page_id, session_id, step, pos, tag, type, id, name, selector, text, label, aria_label, autocomplete, role,
           CASE WHEN value IS NOT NULL AND {has_finding('value')} THEN '' ELSE value END, is_img, img_hints, visible,
           x, y, w, h FROM tagged WHERE kind IS NULL)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
