"""Fixed values the results depend on. They must not be changed to make a check pass."""

# Enumerations.
SEVERITIES = ("INFORMATIONAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")
PROVENANCE_OUTCOMES = (
    "VERIFIED", "VERIFIED_WITH_WARNING", "UNVERIFIED_KEY", "TAMPERED_OUTPUT",
    "SUBSTITUTED_MODEL", "REPLAYED_RECORD", "EXPIRED_KEY", "UNSUPPORTED",
)

# Assurance weights and thresholds.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2, "INFORMATIONAL": 0.0}
DIMENSION_WEIGHTS = {
    "data_integrity": 0.25, "model_integrity": 0.35,
    "inference_provenance": 0.25, "distribution_shift": 0.15,
}
DIMENSION_CATEGORIES = {
    "data_integrity": ("data_integrity", "dataset_integrity"),
    "model_integrity": ("model_integrity",),
    "inference_provenance": ("inference_provenance", "provenance"),
    "distribution_shift": ("distribution_shift", "shift"),
}
DIMENSION_PREFIXES = {
    "data_integrity": "DT-", "model_integrity": "MT-",
    "inference_provenance": "IT-", "distribution_shift": "DS-",
}
DIMENSIONS = tuple(sorted(DIMENSION_WEIGHTS))
QUARANTINE_THRESHOLD = 0.70
REVIEW_THRESHOLD = 0.30
VETO_CONFIDENCE = 0.50

# Contributor risk weights; any other severity counts as the default.
CONTRIBUTOR_WEIGHTS = {"INFORMATIONAL": 0.05, "LOW": 0.15, "MEDIUM": 0.40, "HIGH": 0.75, "CRITICAL": 1.0}
CONTRIBUTOR_DEFAULT_WEIGHT = 0.2

# Weights of the four shift dimensions in the overall distance.
SHIFT_WEIGHTS = {
    "covariate_shift": 0.40, "semantic_shift": 0.30,
    "environmental_drift": 0.20, "adversarial_manipulation": 0.10,
}

# Smallest inputs each data check needs.
CHECK_REQUIREMENTS = {
    "DT-1": {"min_images": 3, "min_classes": 0},
    "DT-2": {"min_images": 6, "min_classes": 2},
    "DT-3": {"min_images": 10, "min_classes": 2},
    "DT-4": {"min_images": 2, "min_classes": 0},
    "DT-5": {"min_images": 6, "min_classes": 0},
}

# Hash-chain genesis.
GENESIS = "0" * 64

# File names and folders of the annotation formats.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
SPLIT_NAMES = ("train", "valid", "val", "test")
IMAGE_FOLDERS = (
    "images", "train", "valid", "val", "test",
    "images/train", "images/valid", "images/val", "images/test",
)
NON_LABEL_FILES = ("classes.txt", "readme.txt", "requirements.txt", "readme.dataset.txt", "readme.roboflow.txt")
YAML_NAMES = ("data.yaml", "data.yml", "dataset.yaml", "dataset.yml")

# Accepted model file extensions and limits of the artifact scan.
MODEL_FORMATS = {"onnx": "onnx", "pt": "pytorch", "pth": "pytorch", "torchscript": "torchscript", "bin": "binary"}
MAX_MODEL_BYTES = 2 * 1024**3
MAX_ARCHIVE_RATIO = 100.0
RATIO_MIN_BYTES = 10 * 1024**2
MAX_ARCHIVE_BYTES = 10 * 1024**3
SCRIPT_SUFFIXES = (".sh", ".bat", ".exe", ".cmd", ".vbs", ".ps1")
# Byte signatures that mark an unsafe serialized model.
UNSAFE_SIGNATURES = (
    b"cos\nsystem", b"cposix\nsystem", b"cnt\nsystem",
    b"cbuiltins\neval", b"cbuiltins\nexec", b"cbuiltins\n__import__", b"cbuiltins\ngetattr",
    b"cbuiltins\nopen", b"cbuiltins\ncompile",
    b"c__builtin__\neval", b"c__builtin__\nexec", b"c__builtin__\n__import__",
    b"subprocess", b"shutil", b"cpty\n", b"csocket\n", b"curllib", b"crequests",
    b"chttp.client", b"cctypes", b"cwinreg",
)

# Wording of the verdict narrative.
NARRATIVE = {
    "headline": "DISPOSITION: %s | Composite Risk Score: %.4f",
    "veto": "CRITICAL VETO TRIGGERED: %d finding(s) forced immediate quarantine: [%s].",
    "veto_item": "%s (%s, conf: %.2f)",
    "profile": "Dimensional Risk Profile: %s.",
    "contributing": "Contributing Findings (%d): [%s].",
    "threat_item": "%s (count=%d)",
    "none": "Contributing Findings: None (zero threat signals detected).",
    "incomplete": "Verification Coverage INCOMPLETE: %d check(s) unperformed/skipped: %s. Asset cannot receive ACCEPT disposition.",
    "complete": "Verification Coverage: COMPLETE. All requested checks executed and evaluated.",
}
