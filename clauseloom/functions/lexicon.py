"""Vocabularies and patterns of the document-to-decision domain, as data.

Every Column function takes its pattern as an argument that defaults to these, so a corpus in
other words can bring its own.
"""

# Patterns, thresholds and word lists that results depend on.
NUMBERED = r"^\s*(\(?\d+(?:\.\d+)*\)?[.)]?|\(?[ivxlIVXL]{1,5}\)[.)]?)\s+(?=[A-Z\"'“])"
OBLIGATION = (
    r"(?i)\b(shall|must|are required to|is required to|required to|will be required|should ensure|shall ensure|"
    r"are advised|is advised|advised to|shall not|must not|may not|are prohibited|is prohibited|"
    r"shall stand withdrawn|stand withdrawn|supersed\w*|no longer applicable|cease to have effect|is hereby|"
    r"shall be discontinued|shall be disabled)\b"
)
INFORMATIONAL = (
    r"(?i)^\s*(dear |yours |regards|please refer|reference is made|with reference to|for information|this is for|"
    r"table of contents|page \d+|annexure|encl)"
)
SUPERSESSION = r"(?i)\b(supersed\w*|shall stand withdrawn|stand withdrawn|no longer applicable|cease to have effect|is hereby cancelled|rescind\w*)\b"
SHEET_ROW = r"^\[row (\d+)\]\s*(.*)$"
#: Words in lower case, of which a text that a pattern finds has one.
SIGNS = {
    OBLIGATION: ("shall", "must", "required", "should ensure", "advised", "may not", "prohibited", "withdrawn", "supersed", "no longer", "cease to", "hereby"),
    SUPERSESSION: ("supersed", "withdrawn", "no longer", "cease to", "hereby", "rescind"),
}
ROW_REF = r"^\(?[A-Za-z]{0,3}[-.]?\d+(?:\.\d+)*\)?$"
LIST_ITEM = r"^\(?(?:[a-zA-Z]|[ivxIVX]{1,5}|\d{1,2})[).]\s+|^\s*[•▪]\s+"
LIST_FAMILIES = (r"(?=(?<![A-Za-z0-9(])\(?[a-z][)]\s)", r"(?=(?<![A-Za-z0-9(])\(?[ivx]{1,5}[).]\s)", r"(?=(?<![A-Za-z0-9(])\(?\d{1,2}[)]\s)", r"(?=[•▪]\s)")
LIST_SIGN = r"(?<![A-Za-z0-9])[ivx]{1,5}[.]\s"  # what a list without brackets or bullets holds, found faster than its marks
LIST_MARK = r"^\(?([a-zA-Z]|[ivxIVX]{1,5}|\d{1,2})[).]\s+"
OPENERS = ("a", "A", "i", "I", "1")
SENTENCE_START = r"[A-Z0-9(]"
POINTS_FORWARD = r"(?i)\b(below|as under|as follows|following|hereunder|under-?mentioned|given in the table)\b|:\s*$"
SENTENCE_END = r"[.;:!?][\"'”’)\]]*$"
EMAIL_HEADER = r"(?i)^(subject|from|to|cc|bcc|date|sent)\s*:\s"
PAGE_FURNITURE = r"(?i)^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$|^[-–]\s*\d{1,4}\s*[-–]$"
SIGNATURE = r"(?i)^(\(?-?\s*sd\s*-?\)?\s*)+$"
SALUTATION = r"(?i)^(dear|respected)\b[^.!?]{0,60}$"
SIGN_OFF = r"(?i)^(yours\b[\w\s,.]{0,25}|(best |kind |warm )?regards|sincerely|thanking you)[,.!]?$"
CONTENTS_ENTRY = r"^(.*?\S)[\s.]+(\d{1,3})$"
CONTENTS_END = r"\d"  # among the last three characters of an entry, as two may be a line's end
WORDS = r"[A-Za-z0-9][\w'’.,&/()-]*"
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "per", "the", "to", "under", "with", "vs")
STRATA = (
    ("Internet Banking", r"internet bank|digital channel|privileged (account|access)|authentication|session|password|cyber|penetration"),
    ("Branchless Banking", r"branchless|agent|level 0|biometric"),
    ("Fraud Prevention", r"fraud|forged|fake|call back|cbc|signature verification"),
    ("Compliance", r"compliance|kyc|aml|cft|due diligence|sanction|politically exposed|beneficial owner|suspicious transaction"),
    ("Data & Reporting", r"report(ing|s)?|return|data quality|reconcil|bi report|dashboard"),
    ("Account Opening", r"account opening|onboard|account holder|dormant|activation"),
    ("Cash & Teller", r"cash|teller|vault|retention limit"),
    ("Credit", r"financ(e|ing)|loan|obligor|provision|classified asset"),
    ("Remittances", r"remittance|transfer|swift|payment order"),
)
DEFAULT_STRATA = "Account Operation"
DEPARTMENT_OF_STRATA = {
    "Internet Banking": "IS&CA", "Data & Reporting": "IS&CA", "Compliance": "MA", "Fraud Prevention": "BA",
    "Branchless Banking": "BA", "Account Opening": "BA", "Account Operation": "BA", "Cash & Teller": "BA",
    "Clearing": "BA", "Collection": "BA", "Remittances": "BA", "Credit": "RR", "ATM": "BA", "Branch Records": "BA",
    "Income & Expenditure": "MA",
}
CITED = r"(?i)((?-i:(?!(?:IN|OF|TO|BY|THE|AND|FOR|VIDE|NO)\b)[A-Z&]{2,10})\s+)?(Circular(?:\s+Letter)?\s*No\.?\s*\d+\s+of\s+\d{4})"
DUTY_JOIN = r"(?i)(?:,\s*and|;\s*and|,|;)\s+(?=(?:shall|must|may not|is required to|are required to)\b)"
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "be", "that", "for", "on", "as", "by", "with", "at",
    "from", "it", "this", "shall", "should", "will", "check", "any", "all", "have", "has", "not", "which", "their",
    "its", "was", "were",
)
CHANGE_TYPES = ("New", "Amendment", "Deletion", "No action")
UNSTRUCTURED_KINDS = ("native-pdf", "scanned-pdf", "mixed-pdf", "image", "txt", "csv", "rtf-stripped", "eml", "msg", "email-body")
LEAD_IN = r":\s*$"
SECTION = r"^(###|\[/?table\])"
DATE = r"\b(\d{1,2}[-/ ][A-Z][a-z]{2,8}[-/ ]\d{2,4}|[A-Z][a-z]{2,8} \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2})\b"
NO_TITLE = ("confidential", "for bank", "internal use", "page ", "table of contents", "all rights", "### sheet", "### slide")
TITLE_LINES, DATE_CHARS = 25, 2500
CARRYING = r"(?i)\b(shall|must|required to|advised|should|will be)\b"
DUTY_VERB = r"(?i)\b(?:shall|must|are required to|is required to|are advised)\b"
DRAFT_MARK, DRAFT_NUMBER = r"^\s*\(?(?:\d+(?:\.\d+)*|[ivxIVX]{1,5}|[a-z])\)?[.):]?\s+", r"^\s*\(?[\divxIVX]+[.)]\s*"
PLURAL = r"(?i)((?<!s)s|records|forms|documents)[.,]*$"
NOT_BE, NOT, BE = r"^not\s+(be|been)\s+", r"^not\s+", r"^(be|been)\s+"
DRAFT_SHORT, DRAFT_LONG = 45, 240
SYSTEM_GAP, POLICY_GAP, PROCESS_GAP = "system|automat|configur", "polic(y|ies)|framework|regulation", "register|record|maintain|document"
HIGH_RISK = "fraud|forged|sanction|money launder|penal|prohibit|shall not|must not|immediately|without delay"
TEST_TYPES = {"New": "New", "Amendment": "Amendment ", "Deletion": "Deletion", "Tagged to different EP strata": "Tagged to different EP strata"}
RISK_LABELS = {"High": "High Risk", "Medium": "Medium Risk", "Low": "Low Risk"}
ROOT_CAUSES = ("System Gap", "Policy Gap", "Process / Procedure Gap", "Implementation Gap")
DEPARTMENTS = ("BA", "MA", "IS&CA", "RR", "SA")
_YES_NO, _SAMPLES = ("Yes", "No"), ("Exception from EP sample", "Exception from Additional sample", "General Exception")
VOCABULARIES = (
    ("Test Type (New/Amendments/Deletion)", tuple(TEST_TYPES.values())),
    ("Marking (Onsite/Offsite/Partially Offsite)", ("Onsite", "Offsite", "Partially Offsite")),
    ("Off-Site Based on Data (Yes/No)", _YES_NO),
    ("Off-Site Based on Scanned Documents (Yes/No)", _YES_NO),
    ("Regulatory Violation (Yes/No)", _YES_NO),
    ("Reportable", _YES_NO),
    ("Risk Type", ("Operational", "Functional", "Reputaional ", "Credit Risk")),
    ("Observation Type", ROOT_CAUSES),
    ("Key Observation", _YES_NO),
    ("Sample Calculation Method", _SAMPLES),
    ("Rectifiable", _YES_NO),
    ("Leakage of Income", _YES_NO),
    ("Exception Type", _SAMPLES),
    ("Root Cause", ROOT_CAUSES),
    ("Amendments Proposed in", ("Approved checklist Implemented in eAudit", "Approved checklist not yet implemented in eAudit")),
    ("Pledge Stock", _YES_NO),
    ("Amendment Type", ("Amendment in Test ", "Amendment in Exception ", "Amendment in Reference ", "Amendment in Risk Level", "Amendment in Strata", "Amendment in Annexure", "Other")),
    ("Audit Dep (BA, MA, IS&CA, RR, SA)", DEPARTMENTS),
    ("System and Source of Verification", ("T24 Live", "T24 CDB", "IMS", "ITS", "eAudit")),
    ("Related Checklist (if any)", ("BAC", "MA", "IS", "CA", "RR", "SA")),
)
MIN_FRAGMENT, DATA_CELL_WORDS, HEADING_WORDS = 25, 8, 12
MIN_DUTY, MAX_DUTIES, MAX_CLAUSES = 40, 6, 250
AMEND_AT, NEW_AT = 0.45, 0.25
MANY_WORDS = r"^[^A-Za-z0-9]*+(?:[A-Za-z0-9][\w'’.,&/()-]*+[^A-Za-z0-9]*+){%d}" % (HEADING_WORDS + 1)  # more WORDS than a heading has
VOCABULARY, TOP_K, FUSION = 4000, 8, 60
BM25_K1, BM25_B, BM25_FLOOR = 1.5, 0.75, 0.25
