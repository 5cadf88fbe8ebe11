"""Defaults that change results.  Everything here is a parameter of the
operators that use it; these are only the defaults."""

from __future__ import annotations

# --- fixed values: must equal the reference for identical file selection ---
# Allowed file extensions (leading dot, case-sensitive).
SUPPORTED_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".php", ".java", ".cpp", ".c",
    ".h", ".hpp", ".cs", ".rb", ".go", ".rs", ".swift", ".kt", ".scala",
    ".md", ".txt", ".json", ".yaml", ".yml", ".xml", ".html", ".css",
    ".scss", ".sass", ".less", ".sql", ".sh", ".bash", ".zsh",
)
# Directory names whose subtrees are skipped.
IGNORE_DIRS = (
    ".git", "node_modules", "vendor", "__pycache__", ".pytest_cache",
    "venv", "env", ".env", "dist", "build", "target", ".idea", ".vscode",
)
# Files larger than this many MiB are skipped (equality is kept).
MAX_FILE_SIZE_MB = 2
# Default result sizes: plain search and grouped (per-repository) search.
SEARCH_LIMIT = 10
GROUPED_SEARCH_LIMIT = 5
# Payload defaults for missing document fields.
DEFAULT_REPO_NAME = "unknown"
# Preview length used when listing hits.
PREVIEW_CHARS = 150
# --- end of fixed values ---

MIB = 1024 * 1024

# Hashed term-vector width (number of buckets).  Sparse, so a wide space
# costs nothing but keeps collisions rare.
DEFAULT_NUM_BUCKETS = 65536

# Distance measures understood by the scoring operators.
METRICS = ("cosine", "cosine_distance", "l2", "dot")
