"""Word lists, patterns, weights and lookup tables that decide results."""

from __future__ import annotations

# --- fixed values: text marks -------------------------------------------------------------------
SENTINELS = ["nan", "none", "[not available]", "[unknown]"]
TRUE_WORDS = ["1", "true", "yes", "t", "y"]
SYNTHETIC_PREFIXES = ["TCGA-SM-", "TCGA-NM-", "SYN-", "SMOKE-"]

# --- fixed values: compound name aliases --------------------------------------------------------
ALIASES = {
    "5 fu": "5-fluorouracil",
    "5 fluorouracil": "5-fluorouracil",
    "fluorouracil": "5-fluorouracil",
    "adria": "doxorubicin",
    "adriamycin": "doxorubicin",
    "doxorubicin hydrochloride": "doxorubicin",
    "ellence": "epirubicin",
    "epirubicin hydrochloride": "epirubicin",
    "taxol": "paclitaxel",
    "paclitaxel taxol": "paclitaxel",
    "taxotere": "docetaxel",
    "docetaxel taxotere": "docetaxel",
    "gemzar": "gemcitabine",
    "gemcitabine hydrochloride": "gemcitabine",
    "cis diamminedichloroplatinum": "cisplatin",
    "cis platinum": "cisplatin",
    "cisplatinum": "cisplatin",
    "platinol": "cisplatin",
    "rapamune": "rapamycin",
    "sirolimus": "rapamycin",
    "cci 779": "temsirolimus",
    "torisel": "temsirolimus",
    "tykerb": "lapatinib",
    "tyverb": "lapatinib",
    "lapatinib ditosylate": "lapatinib",
    "lynparza": "olaparib",
    "ibrance": "palbociclib",
}
ALIASES_SHORT = {
    "5 fu": "5-fluorouracil",
    "5 fluorouracil": "5-fluorouracil",
    "fluorouracil": "5-fluorouracil",
    "adriamycin": "doxorubicin",
    "taxol": "paclitaxel",
    "taxotere": "docetaxel",
    "gemzar": "gemcitabine",
    "sirolimus": "rapamycin",
    "tykerb": "lapatinib",
    "tyverb": "lapatinib",
}

# --- fixed values: language that must not appear in evidence text --------------------------------
BANNED_PHRASES = [
    r"\bbest drug\b",
    r"\bbest treatment\b",
    r"\brecommended treatment\b",
    r"\btreatment recommendation\b",
    r"\bwe recommend\b",
    r"\bshould (be treated|receive|take|use)\b",
    r"\bis eligible\b",
    r"\bpatient is eligible\b",
    r"\bguaranteed\b",
    r"\bcure[sd]?\b",
    r"\bproven to work\b",
    r"\bmust (take|use|receive)\b",
    r"\bwill respond\b",
    r"\bexpected response duration\b",
    r"\bpredicted survival\b",
    r"\bweeks of response\b",
    r"\btime to progression\b",
    r"top (choice|option|recommendation)",
    r"best (drug|agent|option)",
    r"first[- ]line choice",
    r"insufficient data,? but",
    r"low confidence,? however",
]

# --- fixed values: stance wording ----------------------------------------------------------------
SUPPORTING = [
    r"\beffective\b",
    r"\bimproved (survival|response|outcome)\b",
    r"\bsignificant(ly)? (benefit|improvement|response)\b",
    r"\bwell[- ]tolerated\b",
    r"\bsuperior to\b",
]
CONFLICTING = [
    r"\bno (significant )?(benefit|difference|improvement)\b",
    r"\bfailed to (show|demonstrate)\b",
    r"\bresistan(t|ce)\b",
    r"\badverse event[s]?\b",
    r"\bdid not (meet|improve)\b",
    r"\binferior to\b",
]

# --- fixed values: numbers that need no evidence ---------------------------------------------------
FREE_NUMBERS = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "100", "0.05", "0.5", "95"]

# --- fixed values: drug lists ----------------------------------------------------------------------
CONTEXT_DRUGS = [
    "paclitaxel", "docetaxel", "doxorubicin", "epirubicin", "5-fluorouracil", "cyclophosphamide",
    "carboplatin", "cisplatin", "gemcitabine", "capecitabine", "olaparib", "talazoparib", "niraparib",
    "rucaparib", "alpelisib", "capivasertib", "palbociclib", "ribociclib", "abemaciclib", "lapatinib",
    "trastuzumab", "pertuzumab", "tamoxifen", "letrozole", "anastrozole", "exemestane", "everolimus",
    "sacituzumab govitecan",
]
OTHER_KNOWN_DRUGS = [
    "rapamycin", "temsirolimus", "sirolimus", "imatinib", "dasatinib", "sunitinib", "sorafenib",
    "vorinostat", "panobinostat", "bortezomib", "tanespimycin",
]
STRESS_MARKERS = [
    "heat shock", "hsp90", "hsp70", "proteasome", "ubiquitin", "oxidative stress",
    "dna damage response", "general cytotoxicity", "tubulin", "hdac",
]
STRESS_DRUGS = ["tanespimycin", "geldanamycin", "17-aag", "17-dmag", "pu-h71", "alsaprazole", "withaferin-a"]
ENDOCRINE_AGENTS = ["tamoxifen", "fulvestrant", "raloxifene"]
HER2_AGENTS = ["lapatinib", "neratinib", "tucatinib", "trastuzumab"]
SCORED_DRUGS = ["5-fluorouracil", "cisplatin", "docetaxel", "doxorubicin", "epirubicin", "gemcitabine", "paclitaxel"]
CATEGORY_ORDER = [
    "Chemotherapy", "PARP inhibitor", "Endocrine therapy", "CDK4/6 inhibitor",
    "PI3K/AKT/mTOR inhibitor", "HER2-targeted small molecule",
]

# --- fixed values: the pathway of a target ---------------------------------------------------------
TARGET_PATHWAY = {
    "ESR1": "Estrogen", "EGFR": "EGFR", "ERBB2": "EGFR", "IGF1R": "PI3K", "PIK3CA": "PI3K", "AKT1": "PI3K",
    "MTOR": "PI3K", "PTEN": "PI3K", "KRAS": "MAPK", "BRAF": "MAPK", "MAP2K1": "MAPK", "MAPK1": "MAPK",
    "CCND1": "p53", "CDK4": "p53", "CDK6": "p53", "CDKN2A": "p53", "RB1": "p53", "E2F1": "p53", "MKI67": "p53",
    "CDKN1A": "p53",
}

# --- fixed values: countries, coordinates (degrees) and tiers --------------------------------------
HOME = ("ireland", 53.4129, -8.2439)
COUNTRIES = {
    "ireland": (53.4129, -8.2439), "united kingdom": (55.3781, -3.4360), "france": (46.2276, 2.2137),
    "germany": (51.1657, 10.4515), "spain": (40.4637, -3.7492), "italy": (41.8719, 12.5674),
    "netherlands": (52.1326, 5.2913), "belgium": (50.5039, 4.4699), "switzerland": (46.8182, 8.2275),
    "austria": (47.5162, 14.5501), "portugal": (39.3999, -8.2245), "sweden": (60.1282, 18.6435),
    "denmark": (56.2639, 9.5018), "norway": (60.4720, 8.4689), "finland": (61.9241, 25.7482),
    "poland": (51.9194, 19.1451), "united states": (39.8283, -98.5795),
}

# --- fixed values: human-development labels ---------------------------------------------------------
DEVELOPMENT_LABELS = {
    "approved_breast": "Approved drug (breast-cancer context)",
    "approved_oncology": "Approved oncology drug",
    "approved_human_repurposing": "Approved in humans (other indication)",
    "investigational": "Investigational / not approved",
    "withdrawn": "Withdrawn or discontinued",
    "tool_compound": "Research tool compound",
    "non_drug_perturbagen": "Non-therapeutic perturbagen",
    "unresolved": "Unresolved — pending curation",
}
