"""Three form pages as ground truth, with synthetic values."""


def rect(x, y, w, h):
    return {"x": x, "y": y, "width": w, "height": h}


def el(tag, id_, box, type_=None, label=None, auto=None, value=None, visible=True, pii=None, mode="blackout", **more):
    e = {"tag": tag, "type": type_, "id": id_, "selector": f"#{id_}", "label": label, "autocomplete": auto,
         "value": value, "visible": visible, "sensitive": pii is not None, "piiType": pii,
         "mode": mode if pii else None, "rect": rect(*box)}
    e.update(more)
    return e


LOGIN = {
    "page": "login", "title": "Sign in", "layout": {"width": 1280, "height": 800},
    "elements": [
        el("input", "email", (364, 172, 552, 30), "email", "Email or username", "email", "demo.user@example.com",
           pii="email", placeholder="name@company.com"),
        el("input", "password", (364, 250, 552, 30), "password", "Password", "current-password", "Pw@2026#Demo", pii="password"),
        el("input", "otp", (364, 328, 552, 30), "text", "OTP code", "one-time-code", "", pii="otp"),
        el("span", "captchaText", (364, 406, 130, 30), text="A7X3"),
        el("input", "captcha", (510, 406, 406, 30), "text", "Captcha code", "off", ""),
        el("input", "remember", (364, 476, 18, 18), "checkbox", "Keep me signed in on this device"),
        el("button", "submit-btn", (364, 526, 552, 44), "submit", text="Sign in"),
        el("input", "internal-ref", (0, 0, 0, 0), "text", "Internal ref", value="X-9917", visible=False),
    ],
}
CHECKOUT = {
    "page": "checkout", "title": "Checkout", "layout": {"width": 1280, "height": 800},
    "elements": [
        el("input", "fullname", (364, 132, 552, 30), "text", "Full name", "name", "Ana Sample", pii="name"),
        el("input", "phone", (364, 210, 552, 30), "tel", "Mobile number", "tel", "+91 98765 00000", pii="phone"),
        el("textarea", "address", (364, 288, 552, 58), None, "Street address", "street-address", "1 Sample Road", pii="address"),
        el("input", "city", (364, 378, 262, 30), "text", "City", "address-level2", "Springfield", pii="address"),
        el("input", "zip", (642, 378, 262, 30), "text", "PIN code", "postal-code", "400001", pii="address"),
        el("input", "card", (364, 456, 552, 30), "text", "Card number", "cc-number", "4111 1111 1111 1111", pii="credit_card"),
        el("input", "expiry", (364, 534, 262, 30), "text", "Expiry", "cc-exp", "12/28", pii="expiry"),
        el("input", "cvv", (642, 534, 262, 30), "text", "CVV", "cc-csc", "123", pii="cvv"),
        el("input", "orderref", (364, 612, 552, 30), "text", "Order reference (for support)", value="1234567812345678"),
        el("button", "submit-btn", (364, 690, 552, 44), "submit", text="Place order"),
        el("input", "promo-cache", (0, 0, 0, 0), "text", "Promo cache", value="PROMO-2026", visible=False),
    ],
}
KYC = {
    "page": "kyc", "title": "Verification", "layout": {"width": 1280, "height": 800},
    "elements": [
        el("img", "photo", (364, 134, 160, 160), pii="photo", mode="blur", isImg=True, selector=".profile-photo",
           classes=["profile-photo"], alt="Applicant photo", imgHints="photo profile-photo avatar"),
        el("input", "fullname", (556, 132, 360, 30), "text", "Full name (as per ID)", "name", "Ana Sample", pii="name"),
        el("input", "dob", (556, 210, 360, 30), "date", "Date of birth", value="1996-04-17", pii="dob"),
        el("select", "idtype", (556, 288, 360, 30), None, "ID document type", value="Passport"),
        el("input", "idnum", (364, 352, 552, 30), "text", "Government ID number", value="2345 6789 0123", pii="national_id"),
        el("textarea", "address", (364, 430, 552, 58), None, "Residential address", "street-address", "1 Sample Road", pii="address"),
        el("input", "income", (364, 532, 552, 30), "text", "Annual income (optional)", value="1200000", pii="sensitive"),
        el("input", "consent", (364, 590, 18, 18), "checkbox", "I confirm the photo and details above are mine"),
        el("button", "submit-btn", (364, 640, 552, 44), "submit", text="Submit for verification"),
        el("input", "audit-ref", (0, 0, 0, 0), "text", "Audit ref", value="BV-0091", visible=False),
    ],
    "faces": [{"box": rect(402, 150, 84, 98)}],
}
PAGES = (LOGIN, CHECKOUT, KYC)

# (page, selector) -> class, confidence, mode
DETECTED = {
    ("login", "#email"): ("email", 0.95, "blackout"),
    ("login", "#password"): ("password", 0.99, "blackout"),
    ("login", "#otp"): ("otp", 0.95, "blackout"),
    ("checkout", "#fullname"): ("name", 0.80, "blackout"),
    ("checkout", "#phone"): ("phone", 0.93, "blackout"),
    ("checkout", "#address"): ("address", 0.78, "blackout"),
    ("checkout", "#city"): ("address", 0.78, "blackout"),
    ("checkout", "#zip"): ("otp", 0.92, "blackout"),
    ("checkout", "#card"): ("credit_card", 0.97, "blackout"),
    ("checkout", "#expiry"): ("expiry", 0.97, "blackout"),
    ("checkout", "#cvv"): ("cvv", 0.97, "blackout"),
    ("kyc", ".profile-photo"): ("photo", 0.80, "blur"),
    ("kyc", "#fullname"): ("name", 0.80, "blackout"),
    ("kyc", "#dob"): ("dob", 0.93, "blackout"),
    ("kyc", "#idnum"): ("national_id", 0.88, "blackout"),
    ("kyc", "#address"): ("address", 0.78, "blackout"),
    ("kyc", "#income"): ("sensitive", 0.72, "blackout"),
}
TOKENS = {
    ("login", "#email"): "[USER_EMAIL_1]", ("login", "#password"): "[USER_PASSWORD_1]", ("login", "#otp"): "[USER_OTP_1]",
    ("checkout", "#fullname"): "[USER_NAME_1]", ("checkout", "#phone"): "[USER_PHONE_1]",
    ("checkout", "#address"): "[ADDRESS_1]", ("checkout", "#city"): "[ADDRESS_2]", ("checkout", "#zip"): "[USER_OTP_1]",
    ("checkout", "#card"): "[CARD_NUMBER_1]", ("checkout", "#expiry"): "[EXPIRY_1]", ("checkout", "#cvv"): "[CVV_1]",
    ("kyc", "#fullname"): "[USER_NAME_1]", ("kyc", "#dob"): "[DOB_1]", ("kyc", "#idnum"): "[NATIONAL_ID_1]",
    ("kyc", "#address"): "[ADDRESS_1]", ("kyc", "#income"): "[USER_SECRET_1]",
}
UNTOUCHED = {
    ("login", "#internal-ref"): "X-9917", ("checkout", "#orderref"): "1234567812345678",
    ("checkout", "#promo-cache"): "PROMO-2026", ("kyc", "#idtype"): "Passport", ("kyc", "#audit-ref"): "BV-0091",
}
# page -> boxes to destroy (x, y, w, h); the photo and the face make one box
APPLIED = {
    "login": [(360, 168, 560, 38), (360, 246, 560, 38), (360, 324, 560, 38)],
    "checkout": [(360, 128, 560, 38), (360, 206, 560, 38), (360, 284, 560, 66), (360, 374, 270, 38), (638, 374, 270, 38),
                 (360, 452, 560, 38), (360, 530, 270, 38), (638, 530, 270, 38)],
    "kyc": [(360, 128, 168, 170), (552, 128, 368, 38), (552, 206, 368, 38), (360, 348, 560, 38), (360, 426, 560, 66),
            (360, 528, 560, 38)],
}
