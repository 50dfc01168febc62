"""Configuration: every fixed list and lookup the pipeline uses.

The values in the block marked FIXED VALUES must equal the reference
behaviour for results to agree; they are stated as plain text, in their
natural order. Everything else is a tunable default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- FIXED VALUES
# Missing-value tokens, matched case-insensitively against the trimmed value.
MISSING_TOKENS = ("-99", "null", "#null!", "na", "n/a", "", " ")

# Composite targets and their component columns.
KNOWN_COMPOSITES = {
    "any_ssi": ("dsupinfec", "wndinfd", "orgspcssi", "dorgspcssi"),
    "any_reop": ("reoperation", "retorrelated", "reoperation2"),
}

# Values that make a composite component count as "no event".
NO_EVENT_VALUES = ("no complication", "-99", "nan", "", "null", "none")

# Columns that are tried as binary candidates.
POTENTIAL_BINARY = (
    "sex", "ethnicity_hispanic", "transfus", "inout", "dnr", "prem_birth",
    "ventilat", "asthma", "oxygen_sup", "tracheostomy", "stillinhosp",
    "death30yn", "oxygen_at_discharge", "malignancy", "nutr_support",
    "prsepis", "inotr_support", "cpr_prior_surg", "preop_covid", "postop_covid",
    "ped_sap_infection", "ped_sap_prophylaxis", "ped_sap_redosed",
    "ped_spn_antibio_wnd", "ped_spn_antifib", "ped_spn_trnsvol_cell",
    "ped_spn_trnsvol_allogen", "ped_spn_post_trnsvol_cell",
    "ped_spn_post_trnsvol_allogen",
)

# Binary text map (values are compared after trim + lower).
BINARY_MAP = {
    "yes": 1, "y": 1, "true": 1, "t": 1, "1": 1, "male": 1, "Yes": 1,
    "no": 0, "n": 0, "false": 0, "f": 0, "0": 0, "female": 0, "No": 0,
}
# Numbers a binary column may also hold.
BINARY_ALLOWED_NUMBERS = (0.0, 1.0, -99.0, -1.0)

# Values treated as bool-like when looking for categorical columns.
BOOL_LIKE_VALUES = (
    "yes", "no", "true", "false", "0", "1", "null",
    "none", "", "nan", "-99", "-1", "male", "female",
)

# Drug-name dictionary: pattern (substring of the lower-cased value) -> drug, first match wins.
DRUG_PATTERNS = (
    ("ampicillin without sulbactam", "ampicillin"),
    ("ampicillin", "ampicillin"),
    ("cefazolin", "cefazolin"),
    ("cefoxitin", "cefoxitin"),
    ("ceftazidime", "ceftazidime"),
    ("ceftriaxone", "ceftriaxone"),
    ("vancomycin", "vancomycin"),
    ("gentamicin", "gentamicin"),
    ("clindamycin", "clindamycin"),
    ("metronidazole", "metronidazole"),
    ("doxycycline", "doxycycline"),
)
DRUG_SLOT_PREFIX = "ped_sap_name"

# Leak columns dropped before modelling.
LEAK_COLUMNS = (
    "dsupinfec", "wndinfd", "doptodis", "orgspcssi", "dehis", "nwnd",
    "dwndinfd", "dorgspcssi", "ddehis", "ndehis", "norgspcssi",
    "nwndinfd", "noupneumo", "doupneumo", "reopor2cpt1",
    "retor2related", "unplannedreadmission1", "reoporcpt1",
)
ALWAYS_DROP = ("htooday",)

# Lenient date columns.
DATE_COLUMNS = ("date_of_surgery", "date_of_birth")

# Unit factors and validity ranges.
INCH_TO_M = 0.0254
POUND_TO_KG = 0.453592
HEIGHT_M_RANGE = (0.3, 2.5)
WEIGHT_KG_RANGE = (2.0, 300.0)
# BMI flag bands, first match wins: (flag, low, high) -> flag when bmi < low or bmi > high.
BMI_BANDS = (
    ("invalid_extreme", 10.0, 60.0),
    ("invalid_clinical", 15.0, 40.0),
    ("unusual_clinical", 18.5, 30.0),
)
BMI_KEEP_FLAGS = ("valid", "unusual_clinical")

# float32 limits used as a clip range.
FLOAT32_MAX = 3.4028234663852886e38
FLOAT32_MIN = -3.4028234663852886e38

# Characters replaced by "_" in final column names.
FORBIDDEN_NAME_CHARS = "[]<>()"

MAX_CATEGORIES = 50
NUMERIC_THRESHOLD = 0.9
LOW_VARIANCE_THRESHOLD = 0.001
# ------------------------------------------------------------ END FIXED VALUES

# Lower-cased keys of the binary map by value (derived, for expressions).
BINARY_TRUE = tuple(dict.fromkeys(k.lower() for k, v in BINARY_MAP.items() if v == 1))
BINARY_FALSE = tuple(dict.fromkeys(k.lower() for k, v in BINARY_MAP.items() if v == 0))


# Cells that a CSV scan reads as missing (whole cell, as written).
SCAN_MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

@dataclass
class BuildConfig:
    """Options for the training-table builder."""

    target: str = "any_ssi"
    blank_check_columns: tuple[str, ...] = ("ped_sap_name1",)
    missing_tokens: tuple[str, ...] = MISSING_TOKENS
    binary_candidates: tuple[str, ...] = POTENTIAL_BINARY
    drug_patterns: tuple[tuple[str, str], ...] = DRUG_PATTERNS
    leak_columns: tuple[str, ...] = LEAK_COLUMNS
    max_categories: int = MAX_CATEGORIES
    numeric_threshold: float = NUMERIC_THRESHOLD
    variance_threshold: float = LOW_VARIANCE_THRESHOLD
    # "numeric": numeric-looking text becomes double; "lexical": reproduce label codes of sorted strings.
    numeric_mode: str = "numeric"
    # Text that cells still missing at P7 become ("nan" reproduces the reference, where such cells
    # form categories such as ``<slot>_nan``); None keeps them NULL.
    missing_as_text: str | None = None
    # True reproduces "missing becomes 0" in binary columns.
    binary_null_as_zero: bool = True
    # Read the drug slots after drop-first one-hot encoding (reproduces the lost first category).
    drugs_after_drop_first: bool = False
    # P9b (extension, off by default): drop numeric columns with |corr(column, target)| >= this
    correlation_threshold: float | None = None
    order_by: str | None = "row_id"
    forward_fill: bool = True
    extra_drop: tuple[str, ...] = field(default_factory=tuple)
