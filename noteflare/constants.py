"""Fixed values and parameters shared by the Spark code and the oracle SQL.

Everything under a "FIXED VALUES" banner must stay equal to the clinical
rules the library reproduces (term lists, regexes, band edges).  They are
written out plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: cohort selection
# ---------------------------------------------------------------------------
# Diagnosis ids that put a patient in the psoriasis cohort.
PSORIASIS_DX_IDS = (
    1120, 1121, 1122, 1123, 1124, 1216, 1596, 1662, 1663, 1666,
    1667, 1668, 1830, 1872, 1895, 2051, 2052, 2102, 2256,
)
# Default lower bound on the visit date (intent of the malformed literal).
DEFAULT_SINCE = "2023-01-01 00:00:00"
# Lower bound used with the driver's synthetic tables (dates 1992-1998).
FIXTURE_SINCE = "1997-01-01 00:00:00"

# ---------------------------------------------------------------------------
# FIXED VALUES: text columns
# ---------------------------------------------------------------------------
# Ten free-text columns of a note, cleaned of HTML and null-filled.
TEXT_COLS = (
    "complaints", "pastHistory", "assesment", "reviewofsystem",
    "currentmedication", "procedure", "allergy", "examination",
    "patientSummary", "diagnoses",
)
# Columns that get leak masking (suffix "_clean").
MASK_COLS = ("assesment", "complaints", "examination", "patientSummary", "currentmedication")
# Columns joined (space separated) into the TF-IDF document.
TFIDF_INPUT_COLS = ("assesment_clean", "complaints_clean", "examination_clean")
# Numeric model inputs, in model order.
SAFE_NUMERIC_COLS = (
    "patient_age", "has_psoriasis", "on_steroid_med", "on_biologic",
    "itch_present", "dry_skin", "plaques_present", "silvery_scale",
    "elbows_involved", "hyperpigmentation", "smoker", "alcohol_use",
    "family_melanoma",
)
# Columns removed after labelling because they define the label.
LEAK_COLS = (
    "flare_label", "flare_signal", "flare_risk_score", "flare_in_assessment",
    "any_steroid_use", "steroid_started", "complaint_flare_kw", "complaint_no_relief",
)
# Columns removed from the extracted note table before feature work.
EXTRACT_DROP_COLS = (
    "biopsyNotes", "mohsNotes", "referringPhysician",
    "rendering_name", "physician_name", "referring_name", "billing_name",
)
# Feature names a clinician can read (the patient view keeps only these).
INTERPRETABLE_FEATURES = (
    "has_psoriasis", "on_steroid_med", "on_biologic",
    "itch_present", "dry_skin", "plaques_present", "silvery_scale",
    "elbows_involved", "hyperpigmentation", "smoker", "alcohol_use",
    "family_melanoma",
    "complaint_flare_kw", "complaint_no_relief", "flare_in_assessment",
    "trigger_mentioned", "steroid_started", "has_medications",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: lexicons.  Substring terms are matched on lower-cased text;
# patterns are case-insensitive regular expressions.
# ---------------------------------------------------------------------------
LEXICON_PIPELINE = {
    "complaint_flare_terms": ("flare", "worse", "itch", "red", "scaling", "burning", "rash", "lesion"),
    "complaint_no_relief_pattern": "without relief|no improvement",
    "assessment_flare_terms": ("flare", "worsen", "flare-up"),
    "assessment_trigger_terms": ("stress", "infection", "weather", "medication"),
    "assessment_steroid_terms": ("triamcinolone", "steroid", "ointment", "cream"),
    "no_medication_pattern": "no active",
    "steroid_med_pattern": "steroid|triamcinolone|clobetasol|hydrocortisone",
    "biologic_pattern": "adalimumab|secukinumab|ixekizumab|etanercept",
}

LEXICON_EXTENDED = {
    "complaint_flare_terms": (
        "flare", "flaring", "worse", "worsening",
        "itch", "itching", "itchy",
        "red", "redness", "erythema",
        "scaling", "flakes", "flaky", "peeling",
        "burning", "stinging", "pain", "soreness",
        "rash", "eruption", "eruption", "eruption",
        "lesion", "patch", "plaque", "spot",
        "dry", "dryness", "cracking", "bleeding",
        "irritated", "inflamed", "inflammation",
        "swelling", "tender", "thickened", "rough",
        "recurrence", "recurrent", "outbreak", "episode",
        "active", "aggravation", "exacerbation",
    ),
    "complaint_no_relief_pattern": "without relief|no improvement",
    "assessment_flare_terms": ("flare", "worsen", "flare-up"),
    "assessment_trigger_terms": ("stress", "infection", "weather", "medication"),
    "assessment_steroid_terms": ("triamcinolone", "steroid", "ointment", "cream"),
    "no_medication_pattern": "no active|none|not taking|no meds",
    "steroid_med_pattern": (
        "steroid|triamcinolone|clobetasol|hydrocortisone|betamethasone|mometasone|"
        "fluocinonide|desonide|prednisone|methylprednisolone|dexamethasone"
    ),
    "biologic_pattern": (
        "adalimumab|humira|secukinumab|cosentyx|ixekizumab|taltz|etanercept|enbrel|"
        "ustekinumab|stelara|guselkumab|tremfya|risankizumab|skyrizi|brodalumab|siliq|"
        "bimekizumab|tynlmya"
    ),
}

# Exploratory term-rate lexicons (share of assessments mentioning any term).
TERM_RATE_LEXICONS = {
    "flare_terms": ("flare", "flare-up", "worse", "worsen", "worsening"),
    "steroid_terms": ("steroid", "triamcinolone", "clobetasol", "ointment"),
    "trigger_terms": ("stress", "infection", "weather"),
}
# Pairwise-correlated flare features.
FLARE_CORR_FEATURES = ("complaint_flare_kw", "flare_in_assessment", "steroid_started", "itch_present")
# Extra stop words of the word-frequency view.
WORD_FREQ_EXTRA_STOP = ("patient", "apply", "use", "follow", "follow-up")

# ---------------------------------------------------------------------------
# FIXED VALUES: regular expressions
# ---------------------------------------------------------------------------
ICD10_CODE_PATTERN = r"[A-Z]\d{2}\.\d"
PSORIASIS_TYPE_PATTERN = r"(Plaque|Arthropathic|Guttate|Pustular)"
AGE_PATTERN = r"(\d{1,2})\s*year"
GENDER_PATTERN = r"\b(Female|Male)\b"
# Leak masks, applied in this order, each replaced by one space.
MASK_PATTERNS = (
    r"\b(flare|flares|flaring|flare-up|flare up|psoriasis flare)\b",
    r"\b(triamcinolone|clobetasol|hydrocortisone|ointment|apply|start|apply\s+\w+|prescribed|prescription|start\s+)\b",
    r"\b(apply|use)\b.*?(ointment|cream|gel)\b",
)
# HTML entities the oracle's cleaner decodes (those of the given tables), "&amp;" last so "&amp;lt;" stays "&lt;".
HTML_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: score bands
# ---------------------------------------------------------------------------
NOTE_RISK_BANDS = ((0.33, "Low"), (0.67, "Moderate"))  # else "High"
PATIENT_RISK_BANDS = ((0.33, "Low"), (0.50, "Moderate"), (0.67, "Elevated"))  # else "High"
UP_TEXT = "↑ flare risk up"
DOWN_TEXT = "↓ flare risk down"

# ---------------------------------------------------------------------------
# Parameters
# ---------------------------------------------------------------------------
SPLIT_SEED = 42
TEST_FRACTION = 0.20
TFIDF_MAX_FEATURES = 5000
TFIDF_MIN_DF = 5
SVD_COMPONENTS = 100
# Largest dimension we broadcast without a shuffle join: rows, and bytes
# estimated from the schema's per-field widths.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 * 1024 * 1024

# ---------------------------------------------------------------------------
# FIXED VALUES: Spark ML's public English stop-word list, in its own order
# ---------------------------------------------------------------------------
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've",
    "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot",
    "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's", "who's",
    "why's", "would",
)
