"""Column functions: every one takes and returns Columns."""

from ragtables.functions.names import file_extension, has_host, mime_extension, reader_extension
from ragtables.functions.text import clean_text, count_tokens, nfkc, strip
from ragtables.functions.vectors import cosine_distance, cosine_similarity, dot

__all__ = [
    "clean_text", "cosine_distance", "cosine_similarity", "count_tokens", "dot", "file_extension", "has_host",
    "mime_extension", "nfkc", "reader_extension", "strip",
]
