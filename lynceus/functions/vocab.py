"""Header words, action phrases, labels and patterns that results depend on.

Their order is part of their meaning: the first that fits wins.
"""

MAX_HEADER = 64

# Section headers.
PROSE = (
    "BIOGRAPHY", "REPORTS", "IDENTIFICATION", "FUNDING", "ADDITIONAL NOTE", "ADDITIONAL COMMENTS", "COMMENTS", "NOTE",
    "PROFILE NOTES", "KEYWORD NOTE", "OFAC NOTE", "UK NOTE", "EU NOTE", "UN REPORTS", "CRIME - TERROR CATEGORY NOTICE",
    "FATF STATEMENT", "USA - OFAC BROCHURES AND NOTICES", "FENTANYL", "OECD / FATF",
)
JURISDICTIONS = (
    "USA", "UK", "EU", "UN", "CANADA", "AUSTRALIA", "SWITZERLAND", "JAPAN", "UKTR", "USA TREASURY",
    "US DEPARTMENT OF STATE", "US DEPARTMENT OF COMMERCE", "HONG KONG", "SINGAPORE", "NEW ZEALAND", "NORWAY", "ISLE OF MAN",
)
#: (kind, words of which a header contains one), in the order in which they are tried.
HEADER_HINTS = (
    ("IDENTIFIER", ("IMO REGISTRATION", "MSN REGISTRATION", "SWIFT BIC", "UN/LOCODE", "REGISTRATION NUMBER", "CALL SIGN")),
    ("OWNERSHIP", ("SHAREHOLDER", "OWNED", "OWNERSHIP", "STATE INVESTED", "INSTRUMENTALITY")),
    ("ASSET_STATUS", ("OPERATIONAL", "DETAINED VESSEL", "SPECIAL INTEREST VESSEL", "SPECIAL INTEREST AIRCRAFT", "SCRAPPED", "BROKEN UP")),
    ("REGULATORY_WARNING", (
        "WARNING", "ALERT", "UNAUTHORISED", "UNAUTHORIZED", "UNLICENSED", "FINANCIAL SERVICES", "SEC", "FINRA", "CFTC",
        "INVESTOR", "NFA", "CIVIL PENALTIES",
    )),
    ("LAW_ENFORCEMENT", (
        "INTERPOL", "WANTED", "DEBARMENT", "DEBARRED", "ENFORCEMENT", "LAW ENFORCEMENT", "CONVICTION", "INDICTMENT",
        "ENTITY LIST", "DISQUALIFIED DIRECTORS",
    )),
    ("SANCTIONS", (
        "SANCTIONS", "EMBARGO", "REGULATIONS", "DESIGNATION", "ASSET FREEZE", "RESTRICTIVE MEASURES", "INVESTMENT BAN",
        "FINANCIAL RESTRICTIONS", "DUAL-USE", "DUAL USE", "SPECIFIED ENTITIES", "SPECIAL ECONOMIC MEASURES",
        "HIGH RISK THIRD COUNTRIES", "CONTROVERSIAL WEAPONS", "NATIONAL LISTS",
    )),
)
LIST_SOURCE_WORDS = ("SANCTIONS", "EMBARGO", "REGULATIONS")
HISTORY_HEADERS = ("SANCTIONS HISTORY", "REGULATIONS HISTORY")
KINDS = ("SANCTIONS", "REGULATORY_WARNING", "OWNERSHIP", "LAW_ENFORCEMENT", "IDENTIFIER", "ASSET_STATUS", "PROSE", "UNKNOWN")

# Action phrases; a verb's type is that of the first phrase that it contains.
ACTIONS = (
    ("AUTHORISATION", (
        "general license", "general licence", "gl issued", "int/", "authorizing", "authorising", "authorisation issued",
        "authorization issued", "licence issued", "license issued", "non-renewal of general", "specific licence",
        "specific license", "wind-down authorisation", "wind-down authorization",
    )),
    ("REMOVAL", (
        "no longer appears", "no longer subject", "list retired", "removed", "delisted", "de-listed", "deleted", "revoked",
        "rescinded", "withdrawn", "lifted", "cancelled", "canceled", "struck off", "terminated", "expired", "ceased",
        "annulled", "repealed", "suspension lifted", "notice cancelled", "entry removed", "no longer designated",
        "no longer listed", "no longer applies", "no longer applicable", "not in effect", "no longer in effect",
        "no longer named", "list officially withdrawn",
    )),
    ("AMENDMENT", (
        "statement amended", "amended", "updated", "corrected", "modified", "renewed", "extended", "replaced",
        "transferred to", "reinstated", "re-listed", "relisted", "administrative list update", "issues update",
        "issued update", "consolidated", "list officially confirmed", "issues further guidance", "further guidance",
        "officially confirmed",
    )),
    ("ADDITION", (
        "addition", "added", "designated", "listed on", "listed by", "appears on", "appears in", "entry added", "inclusion",
        "included", "red notice issued", "notice issued", "asset freeze imposed", "sanctions imposed", "listed",
        "named on the official", "named on the unofficial", "named on the version", "named on the",
        "restrictive measures", "special economic measures", "assets frozen", "asset freeze", "implemented unscr", "unscr",
        "imposed",
    )),
    ("WARNING", (
        "investors cautioned", "barred from", "censured", "fined", "suspended for", "public administrative proceedings",
        "without admitting", "deemed in default", "initial decision", "agreed to the entry", "registration of each class",
        "unauthorised", "unauthorized", "unlicensed", "disqualified",
    )),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# The grammar of events, stakes and identifiers.
DATE_ACTION = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{4})\s*[-–]\s*([A-Za-z][A-Za-z /'-]{1,60})"
STAKE = r"(?i)([^.;()]{2,120}?)\s*(?:\((SOE|IOS|SOB|POE)\)\s*)?\(\s*(?:(\d{1,3}(?:[.,]\d{1,4})?)\s*%|(unknown\s+percentage))\s*\)"
BARE_OWNER = r"([A-Z][^.;()]{3,120})\s*(?:\((SOE|IOS|SOB|POE)\))?\s*(?:\.|$)"
#: (type, pattern); the value is group 1, which ends the match.
IDENTIFIERS = (
    ("LEI", r"\bLEI[:\s#]*([A-Z0-9]{20})\b"),
    ("SWIFT_BIC", r"\b(?:SWIFT|BIC)(?:\s+(?:BIC|CODE))?[:\s#]*([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"),
    ("IMO", r"\bIMO(?:\s+(?:No|Number|REGISTRATION))?[:.\s#]*(\d{7})\b"),
    ("TAX_ID", r"(?i)\bTax\s+ID(?:\s+No)?[:.\s#]*([A-Z0-9\-/]{4,20})\b"),
    ("GROUP_ID", r"(?i)\bGroup\s+ID[:.\s#]*(\d{1,10})\b"),
    ("SDN_REF", r"(?i)\bSDN\s+Ref\s+No[:.\s#]*(\d{1,10})\b"),
    ("REF_NO", r"(?i)\bRef\s+No[:.\s#]*([A-Z0-9\-/]{1,20})\b"),
    ("REGISTRATION", r"(?i)\b(?:Registration|Reg)\s+No[:.\s#]*([A-Z0-9\-/]{3,25})\b"),
    ("NATIONAL_ID", r"(?i)\bNational\s+ID(?:\s+No)?[:.\s#]*([A-Z0-9\-/.]{4,25})\b"),
    ("PASSPORT", r"(?i)\bPassport\s+No[:.\s#]*([A-Z0-9\-]{4,20})\b"),
    ("CEDULA", r"(?i)\b(?:Cedula|C\.?I\.?|D\.?N\.?I\.?)\s*(?:No\.?)?[:\s#]*([0-9][0-9.\-]{5,20})"),
)
#: (parser, type, rule, most, pattern): what each authority states besides.
AUTHORITY_IDENTIFIERS = (
    ("OFSI", "GROUP_ID", "OFSI.GROUP_ID", 1, r"(?i)Group\s+ID\s*:\s*(\d{1,10})"),
    ("OFSI", "REGIME", "OFSI.REGIME", 1, r"Regime\s*:\s*([A-Za-z ()/,-]{3,60})"),
    ("OFAC", "SDN_REF", "OFAC.SDN_REF", 1, r"(?i)SDN\s+Ref\s+No\.?\s*(\d{1,10})"),
    ("OFAC", "OFAC_PROGRAMME", "OFAC.PROGRAMME", 10, r"\b(SDGT|SDNT|SDNTK|FTO|NPWMD|IRGC|CYBER2|UKRAINE-EO\d+|RUSSIA-EO\d+|SYRIA|IRAN|DPRK\d?)\b"),
    ("EU", "EU_LEGAL_BASIS", "EU.LEGAL_BASIS", 10, r"\b(?:\(EU\)\s*)?(\d{4}/\d{1,4}/(?:CFSP|JHA|EC|EU))\b"),
    ("EU", "EU_REGULATION", "EU.REGULATION", 1, r"(?i)\bRegulation\s+\(E[UC]\)\s+No\.?\s*(\d{1,6}/\d{4})"),
)
#: (parser, words that a header contains, words that it starts with), in the order in which they are tried.
PARSERS = (
    ("OFSI", ("UKHMT", "OFSI", "ISLE OF MAN", "GUERNSEY", "JERSEY"), ("UK SANCTIONS",)),
    ("OFAC", ("OFAC", "SDN", "BIS", "ENTITY LIST"), ("USA SANCTIONS",)),
    ("EU", ("CFSP", "EUROPEAN UNION"), ("EU SANCTIONS",)),
)

# Names, and the labels and words that are none.
NAME_MARKERS = (("PRIMARY", "PRIMARY NAME:"), ("AKA", "a.k.a."), ("AKA", "a.k.a:"), ("AKA", "Alias:"))
NAME_SPLIT = r"(?i)\s*(?:;|\ba\.k\.a\.?\s*:?|\bAKA\s*:|\bAlias(?:es)?\s*:|\n|\.\s+(?=[A-Z])|\b[a-z]\)\s)\s*"
NUMBERED_NAME = r"\bName\s+\d+\s*:\s*"
PAREN_ALIAS = r"(?i)\((?:a\.k\.a\.|f\.k\.a\.|n\.k\.a\.)\s*([^)]{3,400})\)"
PAREN_SPLIT = r"(?i)\s*;\s*(?:a\.k\.a\.|f\.k\.a\.|n\.k\.a\.)?\s*"
ALIAS_PREFIXES = ("a.k.a.", "f.k.a.", "n.k.a.", "a.k.a", "aka")
QUOTED_ALIAS = r"(?<=^|[\s(\[:,])'([\p{L}\p{Nd}][^']{2,119})'"
YEAR = r"\b(19|20)\d{2}\b"
LABELS = (
    "DOB", "D.O.B", "POB", "P.O.B", "Date of birth", "Date of Birth", "Place of birth", "Place of Birth", "Nationality",
    "nationality", "Citizenship", "Gender", "Sex:", "Sex ", "Address", "Addr", "Other Information", "Other information",
    "Position", "Function", "Title:", "Justification", "Listed on", "Type of entity", "Passport", "National ID", "Tax ID",
    "Financial sanctions", "Statement of Reasons", "Reasons:", "Designation", "Secondary sanctions", "Federal Register",
    "Identity Card", "Cedula", "D.N.I.", "Spelling variant", "Good quality", "Low quality", "Date trust services",
    "Individual, Entity", "Regime:", "Group ID", "Ref No",
)
AUTHORITY_LABELS = {
    "OFSI": (
        "Designation source", "Individual, Entity, Ship", "Sex", "Financial sanctions imposed",
        "Date trust services sanctions imposed", "UK Statement of Reasons", "Statement of Reasons", "Group ID", "Regime",
        "Date designated", "Date of Listing", "Last Updated", "Type of entity", "Parent company", "Subsidiaries",
        "Business registration",
    ),
    "OFAC": (
        "SDN Ref No", "Secondary sanctions risk", "Federal Register Notice", "Executive Order", "Program:", "Linked To",
        "c/o", "Cedula No", "D.N.I.", "Identity Card No", "Digital Currency Address", "Vessel Registration Identification",
        "Former Vessel Flag", "Organization Established Date", "Organization Type",
    ),
    "EU": (
        "Reasons", "Date of listing", "Identifying information", "Legal basis", "Council Regulation", "Council Decision",
        "Article", "Annex", "Entry", "Remark",
    ),
}
NO_NAME_PREFIXES = (
    "dob", "d.o.b", "pob", "p.o.b", "nationality", "citizenship", "passport", "date of birth", "place of birth", "gender",
    "sex", "male", "female", "group id", "other information", "justification", "national id", "tax id", "address", "addr",
    "reg no", "registration", "town of birth", "country of birth", "cedula", "identity card", "d.n.i", "former", "minister",
    "deputy", "director", "adviser", "advisor", "member of", "member ", "head of", "chairman", "chairperson",
    "president of", "governor", "ambassador", "secretary general", "secretary of", "general secretary", "commander",
    "chief of", "spouse of", "husband of", "wife of", "son of", "daughter of", "brother of", "sister of", "father of",
    "mother of", "associated with", "activist", "official", "employee", "representative", "listed", "subject to",
    "designated", "financial sanctions", "secondary sanctions", "statement of reasons", "reasons", "date trust",
    "individual, entity", "designation source", "federal register", "spelling variant", "review", "belongs to", "unknown",
    "none", "n/a", "position", "function", "c/o", "additional",
)
