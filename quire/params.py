"""Default parameters and fixed values shared by several operators."""

# Numbers, names and limits that results depend on.
CHARS_PER_TOKEN = 3.8
TOKENS_PER_WORD = 1.3
TARGET_TOKENS = 1000
OVERSIZE_RATIO = 1.15
MAX_NODES_PER_SEGMENT = 35
EXCERPT_LIMITS = (200, 10_000)
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "caption", "figcaption")
INLINE_TAGS = ("a", "b", "strong", "i", "em", "u", "s", "span", "br", "sup", "sub", "code")
ATTRIBUTE_TAGS = ("a", "span", "i", "em", "b", "strong", "u", "sup", "sub", "code")
ACTIVE_TAGS = ("script", "style", "iframe", "object", "embed")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
FILE_TYPES = ("epub", "pdf", "docx", "md", "txt")
MEDIA_TYPES = {
    "epub": "application/epub+zip",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "md": "text/markdown; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
}
MAX_UPLOAD_BYTES = 200 * 1024 * 1024
MAX_ARCHIVE_ENTRIES = 20_000
MAX_ARCHIVE_BYTES = 1024 * 1024 * 1024
MAX_COMPRESSION_RATIO = 250
LOCAL_PROVIDERS = ("lm-studio", "ollama")
FRONT_MATTER_TERMS = (
    "table of contents", "contents", "sommaire", "copyright", "all rights reserved", "isbn", "publisher",
    "title page", "cataloging-in-publication", "dédicace", "dedication",
)
PARSER_VERSION = 5
DEFAULT_TEMPERATURE = 0.15
PROOFREAD_TEMPERATURE = 0.15
SCHEMA_VERSION = 1
TOKEN_PREFIX = "tdk_"
TOKEN_MAX_LENGTH = 200
STATUS_NAMES = {
    "PENDING": "pending",
    "PROCESSING": "running",
    "PAUSED": "paused",
    "COMPLETED": "completed",
    "FAILED": "failed",
}
LANGUAGE_NAMES = {
    "en": "English",
    "fr": "French",
    "es": "Spanish",
    "de": "German",
    "it": "Italian",
    "pt": "Portuguese",
    "ja": "Japanese",
    "zh": "Chinese",
    "ko": "Korean",
    "ru": "Russian",
    "nl": "Dutch",
    "pl": "Polish",
    "auto": "the detected language",
}
# The white-space set of Unicode-aware stripping, information separators included.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Named character references looked up first; the whole table is the standard library's.
FREQUENT_REFERENCES = ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot", "hellip", "mdash", "ndash", "rsquo", "eacute")
