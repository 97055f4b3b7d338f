"""Word lists, tables, patterns and messages that results depend on."""

# Words that keyword search ignores.
STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or",
    "is", "are", "was", "were", "be", "been", "being", "this", "that",
    "these", "those", "it", "its", "as", "by", "with", "from",
)

# Words that a numeric fact's context leaves out, and its length in words.
CONTEXT_STOPWORDS = ("a", "an", "the", "is", "are", "of", "in", "on", "at", "to", "for")
CONTEXT_WORDS = 4

# Units of numeric facts and their patterns over lower-case text.
UNIT_PATTERNS = (
    ("days", r"\b(\d+)\s*days?\b"),
    ("weeks", r"\b(\d+)\s*weeks?\b"),
    ("months", r"\b(\d+)\s*months?\b"),
    ("years", r"\b(\d+)\s*years?\b"),
    ("dollars", r"\$\s*(\d{1,3}(?:,\d{3})*)"),
    ("percent", r"\b(\d+)\s*%"),
)

#: What a text must hold to match the pattern of the same place, which is much quicker to look for.
UNIT_MARKS = ("day", "week", "month", "year", "$", "%")
DEFINITION_MARKS = ("is defined as", "means")

# Definition sentences and their heads, ownership statements, project names.
DEFINITION_PATTERNS = (
    r"\b([A-Z][a-zA-Z]{2,40})\s+is defined as\s+([^.]+)\.",
    r"\b([A-Z][a-zA-Z]{2,40})\s+means\s+([^.]+)\.",
)
CONCEPT_PATTERNS = (r"\b([A-Z][a-zA-Z]{2,40})\s+is defined as\s+", r"\b([A-Z][a-zA-Z]{2,40})\s+means\s+")
TEAM_PATTERN = r"\b([A-Z][a-zA-Z]+) team (?:owns|manages|is responsible for|leads)\b"
PROJECT_PATTERN = r"\bProject ([A-Z][a-zA-Z]+)\b"

# Authority levels, 1 the strongest.
AUTHORITY = {
    1: ("Official Policy", "Formally approved, board- or executive-level policy. Binding."),
    2: ("Approved SOP", "Standard operating procedure, signed off by the owning department."),
    3: ("Official Documentation", "Reference documentation maintained by a team (handbooks, runbooks)."),
    4: ("Project Documentation", "Scoped to a specific project or initiative; not company-wide policy."),
    5: ("Meeting Notes", "Informal record of a discussion or decision, not independently authoritative."),
    6: ("Informal Notes", "Personal or unreviewed notes. Lowest authority; verify before relying on it."),
}
DEFAULT_AUTHORITY = 3

# Words that make a contradiction severe.
SEVERITY_HIGH = ("security", "password", "access", "encryption", "incident")
SEVERITY_MEDIUM = ("finance", "expense", "reimbursement", "budget")

# Entity type by document type; any other is Documentation.
ENTITY_OF_TYPE = {
    "Policy": "Policy",
    "SOP": "Process",
    "Handbook": "Documentation",
    "Documentation": "Documentation",
    "ProjectDocumentation": "Documentation",
    "MeetingNotes": "Documentation",
}

# What a search result says about its ranking.
EXPLANATIONS = {
    "bm25": "Ranked by lexical term overlap (BM25).",
    "dense": "Ranked by semantic similarity (dense retrieval).",
    "hybrid": "Ranked by combining lexical (BM25) and semantic signals via reciprocal rank fusion.",
    "hybrid_rerank": "Ranked by combined lexical + semantic retrieval, then rescored for relevance to your exact query.",
}
UNEXPLAINED = "Ranked by relevance."
MATCHED = " Matched terms: "
NO_OVERLAP = " No literal term overlap -- matched via the semantic component."

# What is said about authority, versions and conflicts.
UNKNOWN_AUTHORITY = "Unrecognized authority level."
SUPERSEDES = "%s (v%s) explicitly supersedes %s (v%s) per document metadata."
OUTRANKS = "%s (%s, level %d) outranks %s (%s, level %d)."
NEWER = " Note: %s is the more recently effective document (%s vs %s) but has lower authority."
UNRESOLVED = "Not resolved by authority ranking: both definitions may be legitimate within their own department's context rather than one being factually wrong."

# Order in which related entities are shown; any other relation is 9.
RELATION_PRIORITY = {"conflicts_with": 0, "supersedes": 1, "duplicate_of": 2, "owned_by": 3, "applies_to": 4}

# Retrieval parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, POOL = 60, 20
CHUNK_TOKENS, OVERLAP = 220, 1
DUPLICATE_THRESHOLD, DEFINITION_THRESHOLD = 0.60, 0.5
MIN_TITLE = 10
