"""Constants and vocabularies that results depend on."""

# Embedding model, chunking and retrieval settings.
EMBEDDING_MODEL = "text-embedding-3-small"
EMBEDDING_VERSION = "v.1.0.0"
EMBEDDING_PROVIDER = "openai"
EMBEDDING_DIMENSIONS = 1536
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
TOP_K = 5
MAX_DISTANCE = 0.5

# Shortest cleaned text that is worth keeping, in characters.
MIN_URL_CHARS = 200
MIN_FILE_CHARS = 50

# Bucket that uploaded files live in.
FILE_BUCKET = "bot-files"

# MIME type -> extension that selects the reader.
MIME_TO_EXTENSION = {
    "application/pdf": ".pdf",
    "text/csv": ".csv",
    "text/plain": ".txt",
    "text/markdown": ".md",
    "text/x-markdown": ".md",
}

# Extension -> reader.
EXTENSION_TO_READER = {".pdf": "pages", ".csv": "csv", ".md": "text", ".txt": "text"}

# Elements without content, boilerplate elements, and the junk words looked for in id, class and role.
NON_CONTENT_TAGS = ("script", "style", "noscript", "svg", "img", "iframe", "canvas")
BOILERPLATE_TAGS = ("nav", "footer", "header", "aside", "form")
JUNK_PATTERN = (
    r"(cookie|consent|gdpr|banner|modal|popup|subscribe|sign[\s_-]?in|sign[\s_-]?up|login|register"
    r"|advert|ads|promo|footer|header|nav|sidebar)"
)

# Allowed values of enumerated columns.
FEEDBACK_VALUES = ("positive", "negative")
OTP_TYPES = ("EMAIL", "MOBILE")
OTP_PURPOSES = ("LOGIN", "VERIFY_EMAIL", "VERIFY_PHONE", "RESET_PASSWORD")
JOB_STATUSES = ("queued", "processing", "completed", "partially_completed", "failed", "cleanup_completed")
SOURCE_STATUSES = (
    "pending", "created", "upload_failed", "queued_for_training", "training", "trained", "training_failed",
)
FILE_STATUSES = ("uploaded", "processing", "processed", "processing_failed")
MESSAGE_ROLES = ("user", "assistant", "system")
MESSAGE_CONTENT_TYPES = ("text", "file")

# Prompt of the assistant.
SYSTEM_PROMPT = "You are a helpful customer support assistant."

# Error messages stored on sources.
ERR_NO_TENANT = "Training source missing bot_id/organization_id"
ERR_INVALID_URL = "Invalid URL"
ERR_NO_FILE_INFO = "Missing file information for this training source."
ERR_FILE_AMBIGUOUS = "Unable to locate the uploaded file for this training source."
ERR_FILE_METADATA = "Uploaded file metadata is incomplete."
ERR_FILE_MISSING = "File upload was not completed. Please re-upload and try again."
ERR_FILE_TYPE = "Unsupported file type"
ERR_FILE_SHORT = "File content too short after loading the data from file"
ERR_PAGE_SHORT = "Page content too short after fallback extraction/cleaning"
ERR_PAGE_PARSE = "Error parsing page"
ERR_PAGE_FETCH = "Failed to fetch URL"
ERR_PAGE_TYPE = "Unsupported content-type"
