"""Fixed values.

Everything in this file is a constant that results depend on: word lists,
file-name sets, patterns, weights, limits and message texts.
"""

# ---- Fixed values: file filter -------------------------------------------

IGNORED_DIRECTORIES = (
    # version control
    ".git", ".svn", ".hg", ".cvs",
    # dependencies
    "node_modules", "bower_components", "jspm_packages",
    # Python environments and caches
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox",
    ".nox", ".venv", "venv", "env", ".env_site",
    # build output
    "dist", "build", "out", "target", "bin", "obj", "pkg",
    # coverage
    "coverage", ".coverage", "htmlcov", ".nyc_output",
    # editors
    ".idea", ".vscode", ".eclipse", ".settings",
    # framework caches
    ".next", ".nuxt", ".turbo", ".cache", ".parcel-cache",
)

BINARY_EXTENSIONS = (
    # compiled code
    ".pyc", ".pyo", ".pyd", ".class", ".jar", ".war", ".ear", ".o", ".obj",
    ".a", ".lib", ".so", ".dylib", ".dll", ".exe", ".bin", ".hex", ".whl",
    # archives
    ".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".iso",
    ".dmg",
    # media
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".tiff", ".webp",
    ".psd", ".ai", ".mp4", ".mov", ".avi", ".mkv", ".wmv", ".mp3", ".wav",
    ".ogg", ".flac", ".aac", ".pdf",
    # fonts
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    # data stores
    ".db", ".sqlite", ".sqlite3", ".mdb", ".parquet", ".arrow", ".wasm",
)

SECRET_GLOBS = (
    ".env", ".env.*", "*.pem", "*.key", "*.pkcs12", "*.p12", "*.pfx",
    "*.keystore", "*.jks", "id_rsa", "id_rsa.*", "id_ed25519",
    "id_ed25519.*", "id_dsa", "id_ecdsa", "credentials.json",
    "service-account*.json", "service_account*.json", "secrets.yaml",
    "secrets.yml", "secrets.json",
)

MAX_FILE_BYTES = 2_097_152
MAX_REPOSITORY_BYTES = 104_857_600
MAX_REPOSITORY_FILES = 2_000
BINARY_SAMPLE_BYTES = 8_192
BINARY_RATIO = 0.30

# ---- Fixed values: languages ---------------------------------------------

LANGUAGE_EXTENSIONS = {
    "Python": (".py", ".pyi", ".pyw"),
    "JavaScript": (".js", ".jsx", ".mjs", ".cjs"),
    "TypeScript": (".ts", ".tsx", ".mts", ".cts"),
    "C": (".c", ".h"),
    "C++": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".c++", ".h++"),
    "Go": (".go",),
    "Rust": (".rs",),
    "Java": (".java",),
    "C#": (".cs",),
    "Kotlin": (".kt", ".kts"),
    "Swift": (".swift",),
    "Scala": (".scala", ".sc"),
    "Dart": (".dart",),
    "Lua": (".lua",),
    "Ruby": (".rb",),
    "PHP": (".php", ".phtml"),
    "R": (".r", ".rmd"),
    "Shell": (".sh", ".bash", ".zsh", ".fish"),
    "PowerShell": (".ps1",),
    "Batch": (".bat", ".cmd"),
    "SQL": (".sql",),
    "HTML": (".html", ".htm", ".xhtml"),
    "CSS": (".css", ".scss", ".sass", ".less"),
    "Markdown": (".md", ".markdown", ".mdown", ".mkd"),
    "YAML": (".yaml", ".yml"),
    "JSON": (".json", ".jsonc", ".json5"),
    "TOML": (".toml",),
    "XML": (".xml", ".svg"),
    "GraphQL": (".graphql", ".gql"),
    "Protocol Buffers": (".proto",),
}

LANGUAGE_FILE_NAMES = {
    "dockerfile": "Dockerfile",
    "containerfile": "Dockerfile",
    "makefile": "Makefile",
    "gnumakefile": "Makefile",
    "cmakelists.txt": "CMake",
    "gemfile": "Ruby",
    "rakefile": "Ruby",
    "vagrantfile": "Ruby",
    "procfile": "Procfile",
    "jenkinsfile": "Groovy",
}

BLOCK_LANGUAGES = (
    "JavaScript", "TypeScript", "Go", "Rust", "Java", "C", "C++", "C#",
)

# ---- Fixed values: chunking ----------------------------------------------

WINDOW_LINES = 50
WINDOW_OVERLAP = 10
HEADING_PATTERN = r"^(#{1,4})\s+(.+)$"
DECLARATION_PATTERN = (
    r"^(?:export\s+)?(?:public\s+|private\s+|protected\s+)?"
    r"(?:static\s+)?(?:async\s+)?(?:abstract\s+)?"
    r"(?:class|struct|interface|enum|function|func|fn|def|sub|void|int|bool|string|var|const|let)\s+"
    r"([A-Za-z_][A-Za-z0-9_]*)[\s\(<\{:]"
)

# ---- Fixed values: query analysis ----------------------------------------

STOPWORDS = tuple("""
a an the this that these those it its
i me my we our you your they them their
there here some any all each every
of in on at to for from with without by
into onto about as and or but not no if
then than so via between within across through
is are was were be been being am
do does did done doing has have had
can could should would will shall may might
must how what where when why which who whom
explain describe show tell give list find get
please help understand know want need mean
use used uses using work works working
implement implemented implements happen happens
perform performs performed handle handled become
becomes take takes make makes identify cite
repository repositories repo project codebase code
application app file files function functions
class classes method methods module modules
relevant part parts thing things way ways
one ones also just only like such other
""".split())

EXTENSION_WORDS = tuple("""
py pyi js jsx ts tsx mjs cjs md mdx
rst txt json yml yaml toml ini cfg go rs
java kt c h cc cpp hpp cs rb php html
css scss sh sql ipynb lock
""".split())

EDGE_PUNCTUATION = "?!,;:\"'`()[]{}<>*"

BROAD_PATTERNS = (
    r"\barchitecture\b",
    r"\boverview\b",
    r"\bhigh[- ]level\b",
    r"\bbig picture\b",
    r"\bwalk me through\b",
    r"\b(main|key|major|core|primary) (components?|modules?|parts|pieces|building blocks)\b",
    r"\bwhat (does|is) (this|the) (repo|repository|project|codebase|application|app)\b",
)
STRUCTURE_PATTERN = r"\b(structure|structured|organi[sz]ed|organi[sz]ation|layout|laid out)\b"
REPOSITORY_NOUN_PATTERN = (
    r"\b(repo|repository|project|codebase|code base|application|app|system)\b"
)

OVERVIEW_HEADING_PATTERN = (
    r"\b(overview|architecture|design|structure|components?|modules?|"
    r"introduction|intro|about|summary|how it works|pipeline|features?)\b"
)
OVERVIEW_DOC_SUFFIXES = (".md", ".mdx", ".rst", ".txt")
OVERVIEW_DOC_STEMS = ("architecture", "overview", "design", "structure")
OVERVIEW_DOC_STEM_PARTS = ("architecture", "overview")
ENTRY_POINT_FILES = (
    "main.py", "__main__.py", "app.py", "manage.py", "cli.py", "server.py",
    "run.py", "wsgi.py", "asgi.py", "index.js", "index.ts", "main.js",
    "main.ts", "server.js", "server.ts", "app.js", "app.ts", "main.go",
    "main.rs", "lib.rs", "program.cs", "main.java", "main.kt", "main.c",
    "main.cpp",
)
ENTRY_POINT_SYMBOLS = (
    "main", "__main__", "cli", "run", "create_app", "app", "program",
)
OVERVIEW_LIMIT = 8

DOC_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".ipynb")
COMMENT_PREFIXES = ("#", "//", "--", ";", "/*", "*", "<!--", "%")
IGNORE_PATTERN_FILES = (
    ".gitignore", ".dockerignore", ".npmignore", ".gitattributes",
    ".eslintignore", ".prettierignore", ".gitkeep", ".keep",
)

# ---- Fixed values: scores and budgets ------------------------------------

WEIGHT_SEMANTIC = 0.70
WEIGHT_LEXICAL = 0.30
BONUS_SYMBOL = 0.20
BONUS_PATH = 0.10
BONUS_OVERVIEW = 0.15
PATH_BONUS_MIN_CONTENT = 0.05
MAX_TOP_K = 50
CANDIDATE_FACTOR = 2
ASSIST_TOP_K = 10
MIN_RELEVANCE = 0.11
TOKEN_BUDGET = 12_000
HISTORY_MESSAGES = 8
CHARS_PER_TOKEN = 4
MESSAGE_OVERHEAD_TOKENS = 4
SNIPPET_CHARS = 500
QUERY_CHARS = 1_000
QUESTION_CHARS = 4_000
USER_CODE_CHARS = 20_000
MAX_FILTER_VALUES = 50

# ---- Fixed values: embeddings --------------------------------------------

EMBEDDING_WIDTH = 1_024
EMBEDDING_SLICE = 64
EMBEDDING_BATCH_TEXTS = 128
EMBEDDING_BATCH_TOKENS = 8_000
EMBEDDING_CHARS_PER_TOKEN = 3.5
EMBEDDING_SPEND_CAP = 2_000_000

# ---- Fixed values: message texts -----------------------------------------

MSG_FILE_LIMIT = "Repository file count exceeds maximum limit of {} files."
MSG_SIZE_LIMIT = "Repository source size exceeds maximum limit of {} bytes."
MSG_SWEPT = "Ingestion was interrupted by a service restart. Please retry."
MSG_UNEXPECTED = "An unexpected error occurred during repository ingestion."
MSG_INSUFFICIENT = (
    "I could not find enough relevant, sufficiently-confident evidence in "
    "this repository's indexed code to answer that question. Try "
    "rephrasing the question, or confirm the repository has been indexed."
)
REVIEW_FOCUSES = (
    "general", "bugs", "security", "maintainability", "performance", "style",
)
RETRIEVAL_MODES = ("hybrid", "semantic", "keyword")
USER_CODE_LABEL = (
    "User-provided code (untrusted input supplied by the user for this review "
    "-- do not assume it is already part of the indexed repository):"
)
