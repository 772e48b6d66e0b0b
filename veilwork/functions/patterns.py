"""The nineteen categories: keys, labels and patterns in Java's dialect.

All patterns run under ``(?U)``: word boundaries, digits and white space by Unicode.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: results depend on each of them ------------------------------------------------

STATES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|"
    "RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|"
    "Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|"
    "Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|"
    "Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|"
    "Washington|West Virginia|Wisconsin|Wyoming"
)
MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|"
    "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
STREETS = (
    "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Boulevard|Blvd|Way|Place|Pl|Terrace|Ter|Highway|"
    "Hwy|Parkway|Pkwy|Trail|Trl"
)
#: An identifier with a digit; one with three characters or more after a digit.
ID = r"[A-Za-z0-9\-]*\d[A-Za-z0-9\-]*\b"
LONG_ID = r"[A-Za-z0-9\-]*\d[A-Za-z0-9\-]{3,}\b"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
YEAR, MONTH_NO, DAY_NO = r"(?:19|20)\d{2}", "(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"

#: key, label, needs a digit in every match, patterns. The three dictionary patterns of names are in ``names.py``.
FIXED = (
    ("names", "Names (person names)", False, (r"\b(?i:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?\b",)),
    ("addresses", "Addresses / Cities / ZIP Codes", False, (
        rf"\b\d{{1,6}}\s+[A-Za-z0-9.'\-]+(?:\s+[A-Za-z0-9.'\-]+){{0,4}}\s+(?i:{STREETS})\b\.?"
        r"(?:\s*(?:#|(?i:Apt|Apartment|Suite|Ste|Unit))\s*\.?\s*\w+)?",
        r"\b(?i:P\.?\s*O\.?\s*Box)\s+\d+\b",
        r"\b\d{5}(?:-\d{4})?\b",
        rf"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+){{0,2}},\s*(?:{STATES})\b",
        rf"\b(?i:Apt|Apartment|Suite|Ste|Unit|Room|Rm)\.?\s*#?\s*{ID}",
    )),
    ("dates", "Dates (birth, admission, death, etc.) / Ages 90+", False, (
        rf"\b{MONTH_NO}[/\-.]{DAY_NO}[/\-.]{YEAR}\b",
        rf"\b(?i:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+{YEAR}\b",
        rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?i:{MONTHS})\.?,?\s+{YEAR}\b",
        rf"\b{YEAR}[/\-.]{MONTH_NO}[/\-.]{DAY_NO}\b",
        r"\b(?i:DOB|D\.O\.B|Date\s+of\s+Birth|Birth\s*date|Born)[:\s]*"
        rf"(?i:{MONTHS})?\.?\s*\d{{1,2}}[,/\-. ]+(?:19|20)?\d{{2}}\b",
        r"\b(?i:age|aged)[:\s]*(?:9\d|1\d{2})\b",
        r"\b(?:9\d|1\d{2})\s*(?i:years?\s+old|y/?o)\b\.?",
    )),
    ("phones", "Phone Numbers", False, (
        r"\b(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b",
        r"\(\d{3}\)\s?\d{3}-\d{4}",
    )),
    ("fax", "Fax Numbers", False, (
        r"\b(?i:Fax|Facsimile)(?:\s*(?i:No|Number|#))?[:\s]*(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b",
    )),
    ("emails", "Email Addresses", False, (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",)),
    ("ssn", "Social Security Numbers", False, (
        r"\b\d{3}-\d{2}-\d{4}\b",
        r"\b\d{3}\s\d{2}\s\d{4}\b",
        r"\b(?i:SSN)[:\s#]*\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    )),
    ("mrn", "Medical Record Numbers", True, (
        rf"\b(?i:MRN|M\.?R\.?\s?#|Medical\s+Record(?:\s*(?:No|Number|#))?)[\s:]*{LONG_ID}",
    )),
    ("health_plan", "Health Plan / Beneficiary Numbers", True, (
        r"\b(?i:Health\s+Plan|Beneficiary|Member|Subscriber|Policy|Group|Insurance)\s*(?i:ID|No|Number|#)[:\s]*" + ID,
    )),
    ("accounts", "Account Numbers", True, (
        rf"\b(?i:Account|Acct|Bank\s+Account|Routing)\s*(?i:No|Number|#)?[:\s]*{LONG_ID}",
    )),
    ("licenses", "Certificate / License Numbers", True, (
        rf"\b(?i:License|Lic|Cert(?:ificate)?|DL|DLN|Driver'?s?\s*Lic(?:ense)?)\s*(?i:No|Number|#)?[:\s]*{ID}",
    )),
    ("vehicles", "Vehicle Identifiers / License Plates / VINs", True, (
        rf"\b(?i:License\s+Plate|Plate|VIN|Vehicle\s+ID)\s*(?i:No|Number|#)?[:\s]*{ID}",
    )),
    ("devices", "Device / Serial Numbers / MAC Addresses", True, (
        r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
        rf"\b(?i:Serial|S/N|Device\s+ID)\s*(?i:No|Number|#)?[:\s]*{ID}",
    )),
    ("urls", "Web URLs", False, (
        r"""\b(?i:https?)://[^\s<>"')\]]+""",
        r"""\b(?i:www)\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+[^\s<>"')\]]*""",
    )),
    ("ips", "IP Addresses", False, (rf"\b(?:{OCTET}\.){{3}}{OCTET}\b",)),
    ("biometric", "Biometric Identifier References", False, (
        r"\b(?i:Fingerprint|Retina\s+Scan|Voice\s*print|DNA\s+(?:Profile|Sample))\s*(?i:No|Number|#|ID)?[:\s]*[A-Za-z0-9\-]*\b",
    )),
    ("unique_ids", "Unique IDs (Student / Employee / Case / File Numbers)", True, (
        r"\b(?i:Student|Employee|Faculty|Staff|Case|File|Reference|Personnel|Applicant|Patient|Client)"
        rf"\s*(?i:ID|Number|No|#)[:\s]*{ID}",
        rf"\b(?i:SID|EID|UID|EMPLID|Banner\s*ID)\s*[:\-#]?\s*{ID}",
        r"\b\d{7,10}\b",
    )),
    ("student_records", "Student Records (GPA / grades / course references)", False, (
        r"\b(?i:GPA|Grade\s+Point\s+Average|Cumulative\s+GPA)[:\s]*\d\.\d{1,3}\b",
        r"\b(?i:Final\s+Grade|Course\s+Grade|Grade)[:\s]*[ABCDF][+\-]?\b",
    )),
    ("financial", "Financial Info (tuition, aid, salaries — FERPA/GLBA)", False, (
        r"\b(?i:Tuition|Fees|Balance|Payment|Financial\s+Aid|Loan|Grant|Scholarship|Salary|Wages?|Stipend|Award)"
        r"[:\s]*\$[\d,]+(?:\.\d{2})?\b",
    )),
)

FERPA = ("names", "addresses", "dates", "phones", "emails", "ssn", "unique_ids", "student_records", "financial")
HIPAA = (
    "names", "addresses", "dates", "phones", "fax", "emails", "ssn", "mrn", "health_plan", "accounts", "licenses",
    "vehicles", "devices", "urls", "ips", "biometric", "unique_ids",
)

#: Header labels of sheets, in order: rule, category. Searched for, letters in either case.
HEADER_RULES = (
    (r"^\s*(?:(?:first|last|full|middle|preferred|maiden|nick\s?|supervisor|employee|student|patient|client|parent|guardian|"
     r"emergency\s+contact)\s*name|name)\s*$", "names"),
    (r"e-?mail", "emails"),
    (r"^\s*(?:phone|mobile|cell|telephone|fax)", "phones"),
    (r"ssn|social\s+security", "ssn"),
    (r"^\s*(?:dob|date\s+of\s+birth|birth\s*date)\s*$", "dates"),
    (r"^\s*(?:street\s*)?address\s*\d*$", "addresses"),
    (r"^\s*(?:zip|zip\s*code|postal\s*code)\s*$", "addresses"),
    (r"^\s*(?:(?:empl|employee|student|patient|client|case|mrn)\s*(?:id|#|no\.?|number)?|id)\s*$", "unique_ids"),
)
HEADER_ROWS, HEADER_CHARS = 10, 60
TOKEN = "[REDACTED]"

# ---- end of the fixed values ---------------------------------------------------------------------

#: What a text must hold for a pattern to match: whether a digit, and one of some words (lower case; none: no condition).
MONTH_WORDS = "jan feb mar apr may jun jul aug sep oct nov dec"
GATES = {
    ("names", 0): (False, "mr ms miss dr prof"),
    ("addresses", 1): (True, "box"),
    ("addresses", 3): (False, ","),
    ("addresses", 4): (True, "apt apartment suite ste unit room rm"),
    ("dates", 1): (True, MONTH_WORDS),
    ("dates", 2): (True, MONTH_WORDS),
    ("dates", 4): (True, "dob d.o.b birth born"),
    ("dates", 5): (True, "age"),
    ("dates", 6): (True, "year yo y/o"),
    ("phones", 1): (True, "("),
    ("fax", 0): (True, "fax facsimile"),
    ("emails", 0): (False, "@"),
    ("ssn", 2): (True, "ssn"),
    ("mrn", 0): (True, "mr m.r medical"),
    ("health_plan", 0): (True, "health beneficiary member subscriber policy group insurance"),
    ("accounts", 0): (True, "account acct routing"),
    ("licenses", 0): (True, "lic cert dl"),
    ("vehicles", 0): (True, "plate vin vehicle"),
    ("devices", 1): (True, "serial s/n device"),
    ("urls", 0): (False, "://"),
    ("urls", 1): (False, "www."),
    ("ips", 0): (True, "."),
    ("biometric", 0): (False, "fingerprint retina voice dna"),
    ("unique_ids", 0): (True, "student employee faculty staff case file reference personnel applicant patient client"),
    ("unique_ids", 1): (True, "sid eid uid emplid banner"),
    ("student_records", 0): (True, "gpa grade"),
    ("student_records", 1): (False, "grade"),
    ("financial", 0): (False, "$"),
}
#: Other letters that case-insensitive patterns take for i, k and s.
FOLDS = "\u0130\u0131\u212a\u017f"


@dataclass(frozen=True)
class Category:
    key: str
    label: str
    needs_digit: bool
    patterns: tuple[str, ...]

    def gate(self, i: int) -> tuple[bool, tuple[str, ...]]:
        digit, words = GATES.get((self.key, i), (True, ""))
        return digit, tuple(words.split())


CATEGORIES = {key: Category(key, label, digit, pats) for key, label, digit, pats in FIXED}
PRESETS = {"FERPA Only": list(FERPA), "HIPAA Only": list(HIPAA), "Full (FERPA + HIPAA)": list(CATEGORIES)}


def unicode(pattern: str) -> str:
    return f"(?U){pattern}"
