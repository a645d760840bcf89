"""Code lists, value sets, URLs and patterns.

These must equal the reference data model's values for results to match, so
they are stated here plainly and in one place. Everything else derives from
them.
"""

# ---------------------------------------------------------------- fixed values
ICD10_CODES = [
    "I10", "E11.9", "J44.1", "I50.9", "N18.3", "J18.9", "K35.80", "S72.001A",
    "M54.5", "F32.9", "G43.909", "N39.0", "K21.9", "I63.9", "E78.5", "J45.909",
]
SNOMED_CONDITIONS = [
    ("38341003", "Hypertension"),
    ("44054006", "Type 2 diabetes mellitus"),
    ("195967001", "Asthma"),
    ("84114007", "Heart failure"),
    ("13645005", "COPD"),
]
LOINC_OBSERVATIONS = [
    ("8480-6", "Systolic blood pressure", "mm[Hg]"),
    ("8462-4", "Diastolic blood pressure", "mm[Hg]"),
    ("8867-4", "Heart rate", "/min"),
    ("2339-0", "Glucose", "mg/dL"),
    ("29463-7", "Body weight", "kg"),
    ("8310-5", "Body temperature", "Cel"),
]
CPT_PROCEDURES = [
    ("93000", "Electrocardiogram"),
    ("80053", "Comprehensive metabolic panel"),
    ("71046", "Chest X-ray"),
    ("99213", "Office visit"),
    ("36415", "Blood draw"),
]
ENCOUNTER_CLASSES = [("AMB", "ambulatory"), ("EMER", "emergency"), ("IMP", "inpatient")]

SYSTEM_ICD10 = "http://hl7.org/fhir/sid/icd-10-cm"
SYSTEM_SNOMED = "http://snomed.info/sct"
SYSTEM_LOINC = "http://loinc.org"
SYSTEM_CPT = "http://www.ama-assn.org/go/cpt"
SYSTEM_NPI = "http://hl7.org/fhir/sid/us-npi"
SYSTEM_MRN = "http://hospital.example.org/mrn"
SYSTEM_ACT_CODE = "http://terminology.hl7.org/CodeSystem/v3-ActCode"
SYSTEM_ORG_TYPE = "http://terminology.hl7.org/CodeSystem/organization-type"

# FHIR R4 value sets (public standard)
GENDER_VALUES = ["male", "female", "other", "unknown"]
ENCOUNTER_STATUS_VALUES = [
    "planned", "arrived", "triaged", "in-progress", "onleave", "finished",
    "cancelled", "entered-in-error", "unknown",
]
EVENT_STATUS_VALUES = [
    "preparation", "in-progress", "not-done", "on-hold", "stopped", "completed",
    "entered-in-error", "unknown",
]
FM_STATUS_VALUES = ["active", "cancelled", "draft", "entered-in-error"]

# Report rules
EXCLUDED_CLAIM_STATUSES = ["cancelled", "entered-in-error"]
DENIED_OR_REJECTED = ["denied", "rejected"]
TEST_NAME_PATTERN = r"(^|\s)(test|dummy)(\s|$)"
TEST_NAME_PATTERN_WIDE = r"(^|\s)(test|dummy|demo|synthetic)($|\s)"
REFERENCE_PREFIX_PATTERN = r"^.*?/"
WELL_FORMED_REFERENCE = r"^[A-Z][A-Za-z]+/"
NPI_PATTERN = r"^[0-9]{10}$"
US_DATE_TIME_FORMAT = "MM/dd/yyyy HH:mm"
# instants are written as yyyy-MM-ddTHH:mm:ss+00:00
INSTANT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
AS_OF_DATE = "2026-09-28"
# metric-name fragments that mark a count-like (non-negative) metric
COUNT_LIKE_FRAGMENTS = ["count", "total", "amount", "num", "sum", "avg", "days", "per_", "rate"]
UNKNOWN_PROVIDER_NAME = "Unknown provider"
UNKNOWN_PROVIDER_STATE = "Unknown"
