"""Patterns, word rules, lookup tables and limits.

Everything in this module is a constant of the data contract.  The values are
written in the notation of the contract (``\\b`` is an ASCII word boundary,
``\\s`` is Unicode white space); ``functions.patterns`` renders them for Spark.
"""

# --------------------------------------------------------------------------
# fixed values: text patterns, in reporting order
# --------------------------------------------------------------------------
TEXT_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"(?:\+91[ -]?)?\b[6-9]\d{9}\b|\b\d{3}[ -]\d{3}[ -]\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("national_id", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("dob", r"\b(19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b"),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b"),
)

# fixed values: token shapes
TOKEN_NAMED = r"\[(USER_[A-Z_]+|CARD_NUMBER|ACCOUNT_NUMBER|CVV|EXPIRY|NATIONAL_ID|DOB)_(\d+)\]"
TOKEN_WHOLE = r"^\[[A-Z_]+_\d+\]$"
TOKEN_BRACKETED = r"\[[A-Z_0-9]+\]"

# --------------------------------------------------------------------------
# fixed values: class -> redaction mode, class -> token kind
# --------------------------------------------------------------------------
REDACTION_MODE = {
    "password": "blackout",
    "email": "blackout",
    "phone": "blackout",
    "credit_card": "blackout",
    "account_number": "blackout",
    "cvv": "blackout",
    "expiry": "blackout",
    "ssn": "blackout",
    "national_id": "blackout",
    "dob": "blackout",
    "otp": "blackout",
    "name": "blackout",
    "address": "blackout",
    "photo": "blur",
    "face": "blur",
    "sensitive": "blackout",
}
TOKEN_KIND = {
    "password": "USER_PASSWORD",
    "email": "USER_EMAIL",
    "phone": "USER_PHONE",
    "credit_card": "CARD_NUMBER",
    "account_number": "ACCOUNT_NUMBER",
    "cvv": "CVV",
    "expiry": "EXPIRY",
    "ssn": "NATIONAL_ID",
    "national_id": "NATIONAL_ID",
    "dob": "DOB",
    "otp": "USER_OTP",
    "name": "USER_NAME",
    "address": "ADDRESS",
    "sensitive": "USER_SECRET",
}
DEFAULT_MODE = "blackout"
DEFAULT_KIND = "USER_SECRET"

# --------------------------------------------------------------------------
# fixed values: field rules of the detector (priority, pattern, class, confidence)
# --------------------------------------------------------------------------
KEYWORD_RULES = (
    (1, r"passwo?r?d|passwd|pwd|passphrase|current-password|new-password", "password", 0.99),
    (2, r"\bpin\b|passcode|\botp\b|one[\s-]?time[\s-]?(code|password)|verification\s+code|m[\s-]?code", "otp", 0.92),
    (3, r"\bcvv\b|\bcvc\b|\bcsc\b|card\s*(verification|security)\s*code|security\s*code", "cvv", 0.97),
    (4, r"\bssn\b|social\s*security(\s*number)?", "ssn", 0.97),
    (5, r"account\s*(no|number|#)?|bank\s*account|\bacc(t|\.|\s*no|\s*num|\s*#)?\b", "account_number", 0.95),
    (6, r"aadhaa?r|uidai|\bpan\b|permanent\s*account\s*number|passport\s*(no|number|#)|driver'?s?\s*licen[cs]e",
     "national_id", 0.95),
    (7, r"date\s*of\s*birth|\bdob\b|\bborn\s*on\b", "dob", 0.95),
    (8, r"salary|income|annual\s*income|ctc\b", "sensitive", 0.72),
    (9, r"\bsecret\b|\btoken\b(?!.*(?:id|name))|api[\s-]?key", "sensitive", 0.75),
)
GATED_RULES = (
    (r"\be[\s-]?mail|electronic\s*mail|\bemail\b", "email", 0.85),
    (r"phone|mobile|contact(\s*number)?|\btel\b|whatsapp", "phone", 0.82),
    (r"full\s*name|\busername\b|\buser\s*name\b|\buser\s*id\b|^name\b|first\s*name|last\s*name|surname"
     r"|applicant\s*name|handle\b", "name", 0.80),
    (r"address|street|city|town|\bzip\b|postal|locality|state\b", "address", 0.78),
)
PHOTO_WORDS = (
    r"photo|avatar|profile[\s-]?(pic|image|photo)|selfie|user[\s-]?pic|applicant\s*image|headshot|portrait"
)
BIRTH_HINT = r"birth|dob|born"
AUTOCOMPLETE_CLASS = {
    "cc-number": "credit_card",
    "cc-csc": "cvv",
    "cc-exp": "expiry",
    "cc-exp-month": "expiry",
    "cc-exp-year": "expiry",
}
AUTOCOMPLETE_CONFIDENCE = 0.97
TEXTUAL_TYPES_DETECTOR = ("", "text", "search", "visible", "tel", "email")
INTERACTIVE_TAGS = ("input", "textarea", "select", "button", "a")
INTERACTIVE_ROLES = ("button", "link", "textbox", "checkbox", "combobox", "menuitem")

# --------------------------------------------------------------------------
# fixed values: field rules of the independent audit
# --------------------------------------------------------------------------
AUDIT_KEYWORD_RULES = (
    (1, r"passwo?r?d|passwd|pwd|passphrase", "password"),
    (2, r"\botp\b|one[\s-]?time[\s-]?(code|password)|verification\s+code|passcode", "otp"),
    (3, r"\bcvv\b|\bcvc\b|\bcsc\b|security\s*code", "cvv"),
    (4, r"\bssn\b|social\s*security", "ssn"),
    (5, r"account\s*(no|number|#)?|bank\s*account|\bacc(t|\.|\s*no|\s*num|\s*#)?\b", "account_number"),
    (6, r"aadhaa?r|uidai|\bpan\b|passport|driver'?s?\s*licen[cs]e", "national_id"),
    (7, r"date\s*of\s*birth|\bdob\b|born\s*on", "dob"),
)
AUDIT_EMAIL = r"e[\s-]?mail"
AUDIT_PHONE = r"phone|mobile|contact|whatsapp"
AUDIT_NAME = (
    r"full\s*name|\busername\b|\buser\s*name\b|\buser\s*id\b|^name\b|first\s*name|last\s*name|surname|handle\b"
)
AUDIT_ADDRESS = r"address|street|locality|postal|\bzip\b|city|town|\bstate\b"
AUDIT_CITY = r"city|town"
AUDIT_ZIP = r"\bzip\b|postal\s*code|pin\s*code"
AUDIT_STATE = r"\bstate\b|province"
AUDIT_COUNTRY = r"country|nation"
AUDIT_CAPTCHA = r"captcha|security\s*check"
AUDIT_ID_TYPE = r"id\s*type|document\s*type|id\s*document"
SUBMIT_WORDS = (
    r"submit|sign\s*in|log\s*in|continue|verify|pay|place\s*order|complete|register|next|confirm"
)
TEXTUAL_TYPES_AUDIT = ("", "text", "search", "email", "tel", "url", "number", "password", "date")

# fixed values: what a planned "type" action writes
FILL_LITERALS = {
    "captcha": "A7X3",
    "country": "India",
    "id_type": "Aadhaar",
    "city": "Mumbai",
    "zip": "400001",
    "state": "Maharashtra",
    "other": "demo_value",
}
FILL_TOKEN = {
    "password": "[USER_PASSWORD_1]",
    "email": "[USER_EMAIL_1]",
    "phone": "[USER_PHONE_1]",
    "credit_card": "[CARD_NUMBER_1]",
    "account_number": "[ACCOUNT_NUMBER_1]",
    "cvv": "[CVV_1]",
    "expiry": "[EXPIRY_1]",
    "otp": "[USER_OTP_1]",
    "ssn": "[NATIONAL_ID_1]",
    "national_id": "[NATIONAL_ID_1]",
    "dob": "[DOB_1]",
    "name": "[USER_NAME_1]",
    "address": "[ADDRESS_1]",
}

# --------------------------------------------------------------------------
# fixed values: audit wording and visible hint length per class
# --------------------------------------------------------------------------
AUDIT_REASON = {
    "email": "Raw email in payload",
    "phone": "Raw phone number in payload",
    "ssn": "Raw SSN in payload",
    "national_id": "Raw national ID pattern in payload",
    "dob": "Raw date-of-birth in payload",
    "credit_card": "Luhn-valid card number in payload",
    "password": "Password field carries a non-token value",
}
AUDIT_HINT_CHARS = {
    "email": 3, "phone": 3, "ssn": 0, "national_id": 2, "dob": 0, "credit_card": 4, "password": 2,
}

# --------------------------------------------------------------------------
# fixed values: limits, weights and scoring bands
# --------------------------------------------------------------------------
ELEMENT_CAP = 400
CLASS_CAP = 8
SUMMARY_LINES = 60
INSPECTOR_ROWS = 40
TITLE_CHARS = 80
LABEL_CHARS = 80
HINT_CHARS = 80
TEXT_CHARS = 60
STEP_BUDGET = 14
SESSION_IDLE_SECONDS = 1800
SLOW_STEP_MS = 1500
MIN_PROTECTED_CHARS = 4
ACTIONS = ("click", "type", "scroll", "finish")
METRIC_WEIGHTS = {"m1": 0.25, "m2": 0.20, "m3": 0.20, "m4": 0.20, "m5": 0.15}
HEAP_BAND_MB = (60.0, 250.0)
PERCEPTION_BAND_MS = (150.0, 700.0)
CYCLE_BAND_MS = (600.0, 2500.0)
MERGE_IOU = 0.30
MERGE_CONTAINMENT = 0.65
DEDUPE_IOU = 0.25
UNION_IOU = 0.40
FACE_IOU = 0.30
REDACTION_PAD = 4
SKIN_CB = (77, 127)
SKIN_CR = (133, 177)
SKIN_MIN_SUM = 90
CELL_PX = 4
DARK_MEAN = 10.0
FLAT_VARIANCE = 8.0
BLOCK_VARIANCE = 12.0

# fixed values: checks and messages of the submitted forms, in the order of the checks
FORM_PATTERNS = {
    "otp": r"^\d{6}$",
    "phone": r"^\+?\d[\d -]{8,14}$",
    "expiry": r"^(0[1-9]|1[0-2])/\d{2}$",
    "cvv": r"^\d{3,4}$",
}
FORM_ID_PATTERNS = (r"^\d{12}$", r"^\d{3}-\d{2}-\d{4}$", r"^[A-Z]{5}\d{4}[A-Z]$")
FORM_MESSAGES = {
    "login": ("OTP must be 6 digits.", "Captcha does not match."),
    "checkout": (
        "Full name is required.", "Mobile number looks invalid.", "Card number failed the Luhn check.", "Expiry must be MM/YY.",
        "CVV must be 3–4 digits.", "Street address is required.",
    ),
    "kyc": (
        "Enter your full name as printed on the ID.", "Date of birth is required.", "ID number format is not recognised.",
        "Residential address is required.", "Consent is required to submit.",
    ),
}

# fixed values: wording of planned actions and of the model prompt
PLAN_TEXT = {
    "scroll": "Target fields are below the fold; scrolling first.",
    "fill": "Filling %s '%s' %s",
    "fill_token": "(token resolved client-side).",
    "fill_plain": ".",
    "click": "Activating primary control '%s'.",
    "finish": "Task '%s' plan executed (%d fields, submit=%s).",
    "idle": "No remaining actionable fields; page state indicates completion.",
}
PLAN_CONFIDENCE = {"scroll": 0.90, "type": 0.92, "click": 0.90, "finish": 0.95, "idle": 0.90}
EMPTY_SUMMARY = "  (no interactive elements)"
PROMPT_TEXT = (
    "TASK: %s\nURL: %s\nSTEP: %d\nVIEWPORT: %dx%d\n"
    "DOM SUMMARY (sanitized, values are tokens):\n%s\n\n"
    "Decide the single next action. Respond with the JSON object only."
)
FOLD_SHARE = 0.85
SCROLL_SHARE = 0.6
DEFAULT_VIEWPORT = (1280, 800)
