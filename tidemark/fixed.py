"""Limits, names and text formats that results depend on."""

# Usage monitoring
DEFAULT_MODEL = "gemini-2.5-flash"
CONTEXT_PREFIX_SIZES = {"gpt-oss-120b": 131072}
CONTEXT_SMALL = 200000
CONTEXT_STANDARD = 1048576
CONTEXT_LARGE = 2097152
CONTEXT_WINDOW = 2000000
DISTILL_TOKENS = 400000
CRITICAL_RATIO = 0.80
STEP_RATIO = 0.05
TIERS = (20, 30, 40, 50, 60, 70)
IDLE_SECONDS = 300
RESET_FLOOR = 0.10
RESET_DROP = 0.5

NO_KEY = "unnamed"

# Status text
STATUS_TEXT = "GCS: "
STATUS_FIRED = ("[GCS: ", "% ⚡ YOLO]")
STATUS_START = "[GCS: 0%]"
STATUS_UNKNOWN = "[GCS: --]"

# Source files
SOURCE_EXTENSIONS = ("py", "js", "ts", "tsx")
SKIPPED_FOLDERS = (".git", "node_modules", "venv", ".venv", "__pycache__", ".gemini", "dist", "build")

# Secrets
SECRET_KEYWORDS = r"(?i)(api[_-]?key|token|secret|password|credential)"
SECRET_HEADER = r"-----BEGIN .* PRIVATE KEY-----"
REDACTED = '"[REDACTED]"'
REDACTED_ENTROPY = '"[REDACTED_HIGH_ENTROPY]"'
ENTROPY_MIN_CHARS = 32
ENTROPY_LIMIT = 4.5

# Elision
UNIT_LIMIT = 30000
OVERSIZE_TITLE = "# [GCS CIRCUIT BREAKER] "
PLACEHOLDER_PY = " pass"
PLACEHOLDER_OTHER = " ..."
ANONYMOUS = "anonymous"
HOT_LOOKUPS = 5
HOT_LINES = 10
HOT_TRUNCATION = "\n        ... (semantic truncation)"
HINT_PREFIX = " # [SEMANTIC_"
HINT_HOT = " [HOT_SYMBOL]"

# Alignment and packing
BLOCK_BYTES = 4096
SLACK_BYTES = 64
MANIFEST_RESERVE = 256
SMALL_BYTES = 1024
PADDING = ("\n<!-- GCS_HYSTERESIS_PADDING_", " -->")
ENTRY_START = ("\n--- GCS_FILE_START: ", " ---\n```")
ENTRY_END = ("\n```\n--- GCS_FILE_END: ", " ---")
MANIFEST_START = ("<!-- GCS_BUCKET_MANIFEST_START: ", " -->\n")
MANIFEST_END = "\n<!-- GCS_BUCKET_MANIFEST_END -->"
BUCKET_PREFIX = "COMMON_BUCKET_"
RESTORE_LIMIT_BYTES = 5242880

# Prompts
EDIT_VERBS = r"(?i)\b(modify|edit|update|change|rewrite)\b"
CANDIDATE_FILE = r"[A-Za-z0-9_./-]+\.(py|js|ts|tsx|json|md|sh)\b"

# Report
TOP_FILES = 30

# Handoff document: layer numbers and names
LAYERS = {
    1: "SYSTEM_MANDATES",
    2: "SKILLS_KNOWLEDGE",
    3: "PROJECT_MANIFEST",
    4: "CHECKPOINT_SUMMARY",
    5: "ACTIVE_SOURCE",
    6: "EPHEMERAL_CONTEXT",
}
MANIFEST_BYTES = 2048
RECENT_TURNS = 3
