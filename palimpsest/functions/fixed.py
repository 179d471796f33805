"""Word lists, patterns and constants that results depend on."""

# --- fixed values: text splitting and templates ---
SPLIT_MAX, SPLIT_OVERLAP, SPLIT_SEARCH = 8000, 1500, 1000
USER_TEXT_IN_FILE_CHANGE = 200

# --- fixed values: cleaning of texts that a model refused, in order ---
KEPT_CATEGORIES = ["L", "N", "P", "M"]
NOISE = [
    (r"(.)\1{3,}", r"\1\1"),
    (r"(?:[0-9a-fA-F]{2}[\s:,]?){8,}", "[binary data]"),
    (r"[A-Za-z0-9+/=]{40,}", "[encoded data]"),
    (r" {2,}", " "),
]

# --- fixed values: retrieval ---
RRF_K, CANDIDATE_POOL = 60, 100
BM25_K1, BM25_B = 1.2, 0.75

# --- fixed values: intents and their patterns, in order ---
INTENT_PATTERNS = {
    "how_to": [
        r"\bhow\s+(to|do|can|should)\b", r"\bsteps?\s+to\b", r"\bguide\b", r"\btutorial\b", r"\bwalkthrough\b",
        r"\bimplement\b", r"\bcreate\b", r"\bset\s*up\b", r"\bconfigure\b",
    ],
    "problem_solving": [
        r"\berror\b", r"\bfail(ed|ing|ure)?\b", r"\bbug\b", r"\bfix\b", r"\bissue\b", r"\bproblem\b",
        r"\bcrash(ed|ing)?\b", r"\bdebug\b", r"\btroubleshoot\b", r"\bwhy\s+(is|does|doesn't|isn't|won't)\b",
        r"\bnot\s+work(ing)?\b", r"\bbroken\b", r"\bdoesn't\s+work\b", r"\bexception\b", r"\btraceback\b",
        r"\btimeout\b", r"\bundefined\b",
    ],
    "code_example": [
        r"\bexample\b", r"\bsample\b", r"\bsnippet\b", r"\bcode\s+for\b", r"\bshow\s+(me\s+)?how\b",
        r"\btemplate\b", r"\bboilerplate\b",
    ],
    "reference": [
        r"\bapi\b", r"\bdocumentation\b", r"\bdocs?\b", r"\breference\b", r"\bsyntax\b", r"\bsignature\b",
        r"\bparameters?\b", r"\breturn\s+type\b",
    ],
    "file_history": [
        r"\bwhat\s+(did|have)\s+(we|i)\s+(change|modify|edit|update)\b", r"\bfile\s+(changes?|modifications?|edits?)\b",
        r"\brecent\s+(edits?|changes?)\b", r"\bshow\s+(me\s+)?changes?\b", r"\bhistory\s+of\b", r"\bwhat\s+happened\s+to\b",
    ],
    "session_context": [
        r"\blast\s+session\b", r"\bprevious(ly)?\b", r"\bearlier\b", r"\bwhat\s+(did|have)\s+we\s+(discuss|talk|work)\b",
        r"\bresume\b", r"\bcontinue\b", r"\bwhere\s+were\s+we\b",
    ],
    "decision_recall": [
        r"\bwhy\s+did\s+(we|i)\b", r"\bdecision\b", r"\bdecided\b", r"\breason(ing)?\b",
        r"\bwhat\s+(was|were)\s+the\s+reason\b", r"\bremember\s+when\b",
    ],
}
DEFAULT_INTENT, DEFAULT_INTENT_CONFIDENCE = "information_seeking", 0.3
PROBLEM_WORDS = r"\b(bug|error|fix|issue|fail|crash|broken)\b"

# --- fixed values: technologies and their keywords, in order ---
TECHNOLOGIES = {
    "python": ["python", "py", "django", "flask", "fastapi", "pandas", "numpy", "pytorch", "tensorflow", "pytest", "pip", "venv", "conda", "pydantic", "asyncio"],
    "javascript": ["javascript", "js", "node", "nodejs", "npm", "yarn", "react", "vue", "angular", "express", "next", "nextjs", "webpack", "babel", "eslint"],
    "typescript": ["typescript", "ts", "tsx", "tsc", "tsconfig"],
    "java": ["java", "spring", "springboot", "maven", "gradle", "junit", "hibernate", "jvm"],
    "csharp": ["c#", "csharp", "dotnet", ".net", "asp.net", "entity framework", "nuget"],
    "go": ["golang", "go mod", "goroutine", "gin", "echo"],
    "rust": ["rust", "cargo", "rustc", "tokio", "serde", "actix"],
    "ruby": ["ruby", "rails", "gem", "bundler", "rake"],
    "php": ["php", "laravel", "symfony", "composer", "wordpress"],
    "swift": ["swift", "swiftui", "xcode", "cocoapods", "ios"],
    "kotlin": ["kotlin", "android", "gradle", "jetpack"],
    "dart": ["dart", "flutter", "pubspec"],
    "docker": ["docker", "dockerfile", "container", "docker-compose", "containerize"],
    "kubernetes": ["kubernetes", "k8s", "kubectl", "helm", "pod", "deployment", "service"],
    "terraform": ["terraform", "tf", "hcl", "infrastructure as code"],
    "ansible": ["ansible", "playbook", "inventory"],
    "aws": ["aws", "amazon", "ec2", "s3", "lambda", "cloudformation", "dynamodb", "rds", "ecs", "eks"],
    "azure": ["azure", "microsoft cloud", "app service", "azure functions"],
    "gcp": ["gcp", "google cloud", "cloud run", "bigquery", "gke"],
    "postgresql": ["postgresql", "postgres", "pg", "psql"],
    "mysql": ["mysql", "mariadb"],
    "mongodb": ["mongodb", "mongo", "mongoose"],
    "redis": ["redis", "cache"],
    "elasticsearch": ["elasticsearch", "elastic", "kibana"],
    "git": ["git", "github", "gitlab", "bitbucket", "branch", "commit", "merge", "rebase", "pull request", "pr"],
    "github_actions": ["github actions", "gh actions", "workflow", "ci/cd"],
    "pytest": ["pytest", "py.test"],
    "jest": ["jest", "react testing library"],
    "ai_ml": ["huggingface", "transformers", "langchain", "openai", "anthropic", "claude", "gpt", "llm", "embedding", "vector search"],
    "vector_db": ["lancedb", "pinecone", "weaviate", "qdrant", "chroma", "faiss", "milvus"],
    "modern_tools": ["fastmcp", "pydantic", "fastembed", "bun", "deno", "uv", "ruff"],
}

# --- fixed values: key terms ---
SHORT_TERMS = ["go", "js", "ts", "py", "db", "ui", "ai", "ml", "ci", "cd"]
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "up", "about", "into", "through", "during",
    "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just",
    "but", "and", "or", "if", "what", "which", "who", "this", "that", "these", "those", "am", "i", "we", "you", "he", "she", "it", "they", "me",
    "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "show", "get", "find", "look",
]
MOST_TERMS = 10

# --- fixed values: file references ---
FILE_EXTENSIONS = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".rb", ".php", ".cs", ".swift", ".kt", ".dart", ".cpp", ".c", ".h", ".json", ".yaml",
    ".yml", ".toml", ".xml", ".html", ".css", ".md", ".txt", ".sh", ".bash", ".sql", ".env", ".config",
]

# --- fixed values: evaluation ---
INTENT_CUES = {
    "how_to": (["step", "first", "then", "next", "finally", "to do this"], 3),
    "problem_solving": (["fix", "solution", "resolved", "workaround", "the issue"], 2),
    "code_example": (["```", "def ", "function ", "class ", "const ", "let ", "var "], 2),
    "file_history": (["edit", "change", "modify", "update", "write", "file_path"], 2),
    "session_context": (["session", "earlier", "previous", "before", "we discussed"], 2),
    "decision_recall": (["decided", "chose", "because", "reason", "approach"], 2),
}
ADEQUATE, COMPLETE, ENOUGH_RESULTS = 0.5, 0.4, 3
ACTION_WORDS = ["should", "must", "need", "important", "note", "remember"]
EXPLAIN_WORDS = ["because", "therefore", "this means", "in order to"]
SIMILAR, MOST_POINTS, MOST_SNIPPETS, MOST_RESULTS = 0.7, 5, 3, 100
SENTENCES_A_RESULT, KEPT_COMPARED, POINTS_COMPARED = 15, 10, 5

# --- fixed values: shell commands that touch files (pattern, operation, summary), in order ---
SHELL_OPERATIONS = [
    (r"\brm\s+(-[^\s]+\s+)?(?<path>[^\s]+)", "delete", "Deleted file"),
    (r"\bmv\s+([^\s]+)\s+(?<path>[^\s]+)", "move", "Moved file"),
    (r"\bcp\s+([^\s]+)\s+(?<path>[^\s]+)", "write", "Copied file"),
    (r"\btouch\s+(?<path>[^\s]+)", "write", "Touched file"),
    (r"\bmkdir\s+(-p\s+)?(?<path>[^\s]+)", "write", "Created directory"),
    (r">\s*(?<path>[^\s]+)", "write", "Wrote file"),
    (r"\btee\s+(-a\s+)?(?<path>[^\s]+)", "write", "Wrote file"),
    (r"\bsed\s+-i.*\s+(?<path>[^\s]+)$", "edit", "Edited file"),
]
PATCH_HEADERS = [("*** Add File: ", "write", "Added file"), ("*** Update File: ", "edit", "Updated file"), ("*** Delete File: ", "delete", "Deleted file"), ("*** Move to: ", "move", "Moved file")]

# --- fixed values: heartbeat sections ---
NUMERIC_KEYS = [
    "size", "queued", "pending", "failed", "failed_count", "queue_size", "queue_max_size", "files_indexed", "files_pending", "files_failed", "total",
    "count", "memory_mb", "cpu_percent", "pending_uploads", "pending_uploads_oldest_age_sec", "active_claims", "blocked_records", "retry_total",
    "failed_files_count", "debounce_ms", "generation", "catchup_failure_count", "catchup_failure_oldest_age_sec", "reindex_generation",
]
TEXT_KEYS = [
    "status", "last_indexed_file_hash", "required_at", "ack_at", "reindex_status", "source_name", "projects_path_hash", "storage_backend",
    "embedding_mode",
]

# --- fixed values: default phrases and limits ---
FILE_CHANGE_PHRASE = "file changes modifications edits"
MOST_UPLOADED, UPLOAD_BYTES = 500, 1 << 20
ID_PATTERN = "^[0-9a-f]{16}$|^[0-9a-f]{64}$"
