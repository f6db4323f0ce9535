"""Text that must be spelled exactly so for results to agree."""

# Trace lines.
SEPARATOR_PREFIX = "-----"
SEPARATOR_LINE = "----- = -----"
TEMP_PREFIX = "temp"
DEBUG_SUFFIX = "_debug"
OUTCOME_PREFIX = "Outcome"
MISSING_PARENT = "N/A"

# Record and dataset columns.
RECORD_COLUMNS = ("TestArgs", "Covariates", "TreatmentVar", "TreatmentVal", "Outcome")
COVARIATE_PREFIX = "cov_"
POSITIVE_OUTCOMES = ("1", "true", "pass")
MISSING_CODE = -1
RANKING_COLUMNS = ("TreatmentVar", "Suspiciousness Score")
SCORE_FORMAT = "%.5f"

# What counts as a number or an integer in text.
NUMBER = r"^[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
PRESENT_NUMBER = r"^[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
INTEGER = r"^[+-]?[0-9]+$"

# Control-flow labels.
METHOD_START = "Method Start:"
METHOD_END = "Method End:"
LOOP_CONDITION = "for-cond:"
TERMINAL_LABEL = "^(return|throw)"
VIRTUAL_ENTRY_ID = "virtualEntry"
VIRTUAL_ENTRY_LABEL = "Virtual Entry"

# Versioned variable names.
VERSIONED_NAME = "([a-zA-Z]+)_([0-9]+)"
VERSION_SUFFIX = "_[0-9]+$"

# Letters of random inputs, and their shortest and longest length.
INPUT_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
INPUT_MIN_LENGTH = 3
INPUT_MAX_LENGTH = 7
