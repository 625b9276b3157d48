"""Names, word lists and patterns the results depend on."""

# Column layouts of the landed CSV files.
GITHUB_COLUMNS = [
    "repo", "is_pr", "issue_number", "comment_type", "comment_id",
    "comment_created_at", "comment_author", "text", "comment_url", "context_id",
    "container_title", "container_state", "container_url",
    "container_created_at", "container_updated_at", "container_labels",
]
REDDIT_COLUMNS = [
    "subreddit", "submission_id", "submission_created_utc", "submission_title",
    "comment_id", "comment_created_utc", "comment_author", "comment_body",
    "comment_permalink", "submission_url",
]
CORE_COLUMNS = ["id", "text", "label", "source", "created_at", "context_id"]
EXTENDED_COLUMNS = [
    "id", "text", "context", "label", "source", "created_at", "repo",
    "issue_number", "is_pr", "comment_type", "context_id", "comment_author",
    "comment_url", "container_url",
]

# Columns tried in turn when mapping an unknown input. The last
# entry of each list serves the forum CSV.
TEXT_CANDIDATES = ["text", "body", "comment", "content", "selftext", "comment_body"]
ID_CANDIDATES = ["id", "comment_id", "id_str", "name"]
CREATED_CANDIDATES = [
    "created_at", "comment_created_at", "container_created_at", "createdUtc",
    "created_utc", "comment_created_utc",
]
URL_CANDIDATES = ["comment_url", "container_url", "url"]

# Noise filter.
BOT_PATTERN = (
    r"(bot$)|(\[bot\])|(github-actions)|(^k8s-ci-robot$)|(dependabot)|(^renovate)|(^mergify)"
)
TEMPLATE_SENTENCES = [
    "This issue is currently awaiting triage",
    "Instructions for interacting with me using PR comments are available here",
]
MIN_WORDS = 10

# Weak labels.
SECURITY_LABELS = ["sig/security", "area/security", "kind/security"]
BUG_LABELS = ["kind/bug", "sig/bug", "triage/accepted", "area/bug"]
SECURITY_KEYWORDS = ["cve-", "vulnerability", "exploit", "rce", "xss", "csrf", "ssrf"]
BUG_TITLE_KEYWORDS = ["bug"]

# Text put in front of a comment by source, and its test word.
DOMAIN_PREFIXES = {"github": "<GITHUB> ", "reddit": "<REDDIT> "}

# Bodies of comments that were taken down.
REMOVED_BODIES = ["[removed]", "[deleted]"]

# Default title keywords.
TITLE_KEYWORDS = [
    "bug", "error", "failure", "fault", "issue", "regression", "crash", "hang", "freeze",
    "segfault", "panic", "unexpected", "incorrect", "wrong", "mismatch",
    "null pointer", "nil pointer", "undefined behavior", "ub", "race condition",
    "deadlock", "livelock", "timeout", "latency spike",
    "memory leak", "leak", "oom", "out of memory", "high memory", "use-after-free",
    "double free", "dangling", "buffer overflow", "stack overflow", "heap overflow",
    "out-of-bounds", "oob", "off-by-one", "overread", "overwrite", "corruption", "corrupt",
    "infinite loop", "loop", "recursion", "stack exhaustion",
    "security", "vulnerability", "vuln", "cve", "exploit", "rce", "lpe",
    "privilege escalation", "xss", "cross-site scripting", "csrf", "ssrf", "sqli",
    "sql injection", "command injection", "code injection", "template injection",
    "path traversal", "directory traversal", "insecure", "exposure",
    "information disclosure", "auth bypass", "authentication bypass",
    "authorization bypass", "weak cryptography", "weak crypto", "insecure default",
    "hardcoded secret", "sensitive data", "token leak", "credential leak",
]
# Body keywords are the title keywords and these.
BODY_KEYWORDS = TITLE_KEYWORDS + [
    "se cuelga", "se bloquea", "comportamiento extraño", "no esperado",
    "datos sensibles", "credenciales", "token", "clave", "contraseña",
]

# Run parameters.
SPLIT_RATIOS = (0.70, 0.15, 0.15)
MAX_LEN = 384
OVERLAP = 128
SPECIAL_TOKENS = 2
TARGET_PRECISION = 0.95
MID_BAND = 0.05
SNIPPET_CHARS = 1000
HISTOGRAM_BINS = 30
DENOMINATOR_FLOOR = 1e-9
DEFAULT_DAYS = 365
# Seconds of the latest instant a nanosecond clock can hold;
# larger epoch values are read as invalid.
MAX_EPOCH_SECONDS = 9_223_372_036
