"""Column-expression builders (JVM-side, no Python in the row path)."""

from quarry.functions.text import (  # noqa: F401
    content_hash, decode_text, embedding_text, normalize_newlines, path_extension,
    path_has_ignored_dir, preview, repo_name_from_url, term_bucket, tokens,
)
from quarry.functions.vector import cosine, dot, l2_squared, norm, similarity  # noqa: F401
