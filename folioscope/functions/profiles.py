"""Profiles: labels, patterns, word lists and thresholds that operators take as parameters.

``LEASE_HE`` serves Hebrew rental contracts, ``NEUTRAL`` any language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

HEBREW = "֐-׿"

# The placeholders, labels, patterns, word lists and thresholds below are what results are compared by.
NAME = "[ИМЯ УДАЛЕНО]"
ID = "[ID УДАЛЁН]"
PHONE = "[ТЕЛЕФОН УДАЛЁН]"
EMAIL = "[EMAIL УДАЛЁН]"
BANK = "[БАНКОВСКИЕ ДАННЫЕ УДАЛЕНЫ]"
ADDRESS = "[АДРЕС УДАЛЁН]"
SIGNATURE = "[ПОДПИСЬ УДАЛЕНА]"
GUARANTOR = "[ДАННЫЕ ПОРУЧИТЕЛЯ УДАЛЕНЫ]"
PLACEHOLDERS = (NAME, ID, PHONE, EMAIL, BANK, ADDRESS, SIGNATURE, GUARANTOR)

COUNTERS = ("names", "ids", "phones", "emails", "bank_details", "addresses", "signatures", "guarantor_details")

EXPLICIT_SEPARATOR = r"\s*[:#*־\-–—]\s*"
FLEXIBLE_SEPARATOR = rf"(?:{EXPLICIT_SEPARATOR}|\s+)"
FIELD_VALUE = r"[^,\n.;]{1,120}"

MONEY_CONTEXT = (
    "שכר דירה", "דמי שכירות", "פיקדון", "שיק ביטחון", "בטוחה", "ערבות", "שטר חוב", "נספח", "כתב ערבות", "רשימת ציוד", "פרוטוקול מסירה",
    "שוכר חלופי", "עזיבה מוקדמת", "הודעה מראש", "בלאי סביר", "צביעה", "תיקונים", "חשבונות", "ועד בית", "ארנונה", "₪",
)
INDICATORS = ("חוזה שכירות", "הסכם שכירות", "המשכיר", "השוכר", "תקופת השכירות", "דמי שכירות")
LEASE_MARKERS = (
    "הסכם שכירות", "משכיר", "שוכר", "דירה", "דמי שכירות", "תקופת השכירות", "ארנונה", "ועד הבית", "חשמל", "מים", "פיקדון", "ערבות", "שיק",
    "נספח", "חתימה", "פינוי", 'ש"ח', 'ע"י', 'ב"כ',
)
TOPICS = {
    "Parties": ("party", "parties", "client", "vendor", "contractor"),
    "Payment terms": ("payment", "invoice", "fee", "amount", "price"),
    "Term or duration": ("term", "duration", "effective date", "expires", "expiration"),
    "Termination": ("terminate", "termination", "cancel", "cancellation"),
    "Governing law": ("governing law", "jurisdiction", "venue", "state law"),
    "Signatures": ("signature", "signed", "signatory", "authorized representative"),
}
CAUTIONS = {
    "Automatic renewal": ("auto-renew", "automatic renewal", "renews automatically"),
    "Broad indemnity": ("indemnify", "hold harmless"),
    "Unlimited liability": ("unlimited liability", "without limitation", "consequential damages"),
    "Exclusivity": ("exclusive", "exclusivity", "sole provider"),
}
COMPLETENESS = {
    "appendix": (r"נספח(?:ים|י)?", r"נספח\s+[א-תA-Z0-9]"),
    "promissory_note": (r"שטר\s+חוב",),
    "guarantee": (r"כתב\s+ערבות", r"ערבות", r"ערב(?:ים|ות)?", r"ПОРУЧИТЕЛ"),
    "checks": (r"שיק\s+ביטחון", r"שיק(?:ים)?", r"צ'?ק(?:ים)?", r"המחא(?:ה|ות)", r"בטחונות"),
    "inventory": (r"רשימת\s+ציוד", r"רשימת\s+תכולה", r"תכולה", r"ציוד"),
    "handover_protocol": (r"פרוטוקול\s+מסירה", r"מסירת\s+הדירה", r"מעמד\s+המסירה"),
    "signature_pages": (r"עמוד\s+חתימות", r"חתימות", r"חתימה", r"ПОДПИС"),
}
EMAIL_PATTERN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN = r"(?<!\d)(?:\+972[\s-]?|0)(?:5\d|[23489]|7[0-9])[\s-]?\d{3}[\s-]?\d{4}(?!\d)"
ID_PATTERN = r"(?<![\d/.,₪-])\d{8,9}(?![\d/.,₪-])"
ID_LABEL = r"ת\.?ז\.?|תז|תעודת\s+זהות|מספר\s+זהות"
IBAN_PATTERN = r"(?i)\bIL\d{2}[\s-]?(?:\d[\s-]?){10,25}\b"
# End of the fixed values.


@dataclass(frozen=True)
class Labelled:
    """A field with a label: what follows it, up to a comma, line end, full stop or semicolon, is replaced."""

    counter: str
    placeholder: str
    labels: tuple[str, ...]
    separator: str = FLEXIBLE_SEPARATOR


@dataclass(frozen=True)
class Pattern:
    """A pattern whose matches are replaced; not on lines that hold an ``unless`` word, unless they match ``though``."""

    counter: str
    placeholder: str
    pattern: str
    unless: tuple[str, ...] = ()
    though: str = ""


@dataclass(frozen=True)
class Profile:
    """What redaction and usability gates go by. Rules are applied in order, and their order matters."""

    redaction: tuple[Labelled | Pattern, ...]
    letters: str = "A-Za-z"
    indicators: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    min_letters: int = 120
    min_indicators: int = 0
    min_clauses: int = 4
    max_garbage: float = 0.35
    max_pages: int = 80
    min_length: int = 250
    clause_letters: int = 15
    high: tuple[int, int, int] = (900, 10, 0)
    medium: tuple[int, int] = (350, 6)
    useful: str = r"\s.,;:!?/\"'()\[\]\-"
    page_header: str = r"(?i)---\s*(?:PDF )?PAGE\s+(\d+)(?::[^-]*)?\s*---"
    counters: tuple[str, ...] = field(default=COUNTERS)


LEASE_HE = Profile(
    redaction=(
        Labelled("guarantor_details", GUARANTOR, (r"שם\s+הערב", r"ת\.?ז\.?\s+ערב", r"תז\s+ערב", r"מספר\s+זהות\s+ערב")),
        Labelled("addresses", ADDRESS, (r"כתובת",)),
        Labelled("phones", PHONE, (r"טלפון", r"נייד")),
        Labelled("emails", EMAIL, (r"דואר\s+אלקטרוני", r"מייל", r"אימייל")),
        Labelled("names", NAME, (r"שם\s+בעל\s+הדירה", r"שם\s+המשכיר", r"שם\s+השוכר", r"שם\s+הסוכן", r"שם\s+המתווך", r"מיופה\s+כוח")),
        Labelled("names", NAME, (r"סוכן", r"מתווך", r"שם(?!\s+הערב)"), EXPLICIT_SEPARATOR),
        Labelled("signatures", SIGNATURE, (r"חתימה", r"חתימת\s+השוכר", r"חתימת\s+המשכיר", r"חתימות")),
        Pattern("emails", EMAIL, EMAIL_PATTERN),
        Pattern("phones", PHONE, PHONE_PATTERN),
        Labelled("ids", ID, (r"תעודת\s+זהות", r"ת\.?ז\.?(?!\s*ערב)", r"תז(?!\s*ערב)", r"מספר\s+זהות(?!\s*ערב)")),
        Pattern("ids", ID, ID_PATTERN, MONEY_CONTEXT, ID_LABEL),
        Labelled(
            "bank_details",
            BANK,
            (r"פרטי\s+בנק", r"חשבון\s+בנק", r"מספר\s+חשבון", r"בנק", r"סניף", r"מספר\s+שיק", r"מספר\s+צ'?ק", r"מס[׳']?\s+שיק", r"שיק\s+מס[׳']?", r"שיק\s+מספר", r"צ'?ק\s+מספר"),
        ),
        Pattern("bank_details", BANK, IBAN_PATTERN),
    ),
    letters=HEBREW,
    indicators=INDICATORS,
    markers=LEASE_MARKERS,
    min_indicators=2,
    high=(900, 10, 4),
    useful=rf"{HEBREW}\d\s.,;:!?/₪\"'()\[\]\-",
    page_header=r"(?i)---\s*СТРАНИЦА\s+(\d+)(?::[^-]*)?\s*---",
)

NEUTRAL = Profile(
    redaction=(
        Pattern("emails", "[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
        Pattern("phones", "[PHONE]", r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -]?[0-9]{3,4}"),
        Pattern("ids", "[ID]", r"[0-9]{8,}"),
    ),
    letters="A-Za-zÀ-ÖØ-öø-ÿ",
    useful=r"A-Za-zÀ-ÖØ-öø-ÿ0-9\s.,;:!?/\"'()\[\]\-",
)
