"""Schemas and fixed values of the knowledge-bundle model."""

CONCEPT = (
    "id string, type string, title string, description string, tags array<string>, body string, resource string, source_digest string, "
    "verified array<struct<by:string,at:string>>, generated struct<by:string,at:string>, "
    "sources array<struct<id:string,resource:string,title:string,author:string,last_modified:string>>, "
    "valid_from string, valid_until string, supersedes array<string>, last_verified string, status string, stale_after string"
)
FINDING = "severity string, rule_seq int, code string, file string, message string"

# Query results depend on them.
STOPWORDS = (
    "a an the and or but if then else when at by for with about into through during before after above below to from up down "
    "in out on off over under again further once here there all any both each few more most other some such no nor not "
    "only own same so than too very can will just should now is are was were be been being have has had do does did of as it its this that these those"
).split()
BM25_K1, BM25_B = 1.2, 0.75
FIELD_WEIGHTS = (("id", 3), ("title", 3), ("description", 2), ("tags", 2), ("body", 1))
MIN_SOURCE_CHARS, PREAMBLE_TITLE, BODY_MAX, DESCRIPTION_MAX, SENTENCE_MIN = 1000, 80, 8000, 200, 20
SEE_ALSO_MAX, MENTION_MIN, BACKLINK_MIN = 8, 4, 4
TITLE_THRESHOLD, EMBEDDING_THRESHOLD, EMBED_CHARS = 0.8, 0.87, 4000
MAX_SUPERSEDES, TRAVERSE_DEPTH = 100, 3
STEM_MAX = 252  # bytes of a file name before its .md
PAGE_UNITS, CHUNK_LINES, CHARS_PER_TOKEN, GRAPH_NODES = 50, 50, 4, 2000
EVAL_THRESHOLDS = {"context_relevancy": 0.6, "faithfulness": 0.6, "answer_relevancy": 0.4}
SENTENCE_SUPPORT, REFERENCE_WARN = 0.5, 0.2
RESERVED = ("index.md", "log.md")
NO_TEXT = "Draft concept extracted without LLM; needs review"
TRUNCATED = "\n\n[... truncated: section body exceeds no-LLM limit ...]"
EXTERNAL = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
LINK = r"(?<!!)\[([^\[\]]*)\]\(([^()\n]*)\)"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
FENCE = r"^\s*(```|~~~)"
CHANGE_ORDER = ("added", "updated", "renamed", "removed", "unchanged")
STATUSES = ("draft", "stable", "deprecated")
