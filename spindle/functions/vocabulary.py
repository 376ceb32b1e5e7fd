"""Word lists, patterns, tables and weights that results depend on. Kept plainly, in natural order."""

# Topic words -------------------------------------------------------------------------------------
STOP_WORDS = (
    "a an the and or but if then else for to of in on at by with from as is are was were be been being this that these those it "
    "its i you he she we they me my your our do does did can could should would will shall please now also just so very some any all "
    "how what why when which who whom here there about into up down out over again more most let lets make get got want need give us"
).split()
FOLLOW_UP_WORDS = "continue add fix improve expand optimize generate create build implement deploy refactor update change same it this that them again".split()

# Prompts -----------------------------------------------------------------------------------------
BARE_REFERENCES = ("continue", "go on", "keep going", "carry on", "proceed", "next", "do the same", "same thing", "same as before", "again", "one more", "and", "more", "go ahead")
FOLLOW_UP_MARKERS = (
    "continue", "do the same", "improve it", "improve this", "make it better", "fix it", "fix this", "expand it", "expand this", "optimize it",
    "optimize this", "refactor it", "refactor this", "add ", "also add", "now add", "now create", "now generate", "now build", "now make",
    "now implement", "implement ", "generate backend", "generate frontend", "create frontend", "create backend", "deploy it", "deploy this",
    "update it", "change it", "enhance it", "extend it", "same but", "and also", "next step", "keep the", "based on that", "using that",
)
NEW_TOPIC_OPENERS = ("explain", "what is", "what are", "tell me about", "define", "compare", "difference between", "how does", "how do", "who is", "give me a joke", "tell me a joke", "translate", "summarize", "summarise")

# Domains -----------------------------------------------------------------------------------------
KNOWLEDGE_OPENERS = ("explain", "what is", "what are", "what's", "define", "describe", "compare", "difference between", "how does", "how do", "why does", "why is", "who is", "who was", "tell me about", "teach me")
SOFTWARE_MARKERS = (
    "python", "java", "javascript", "typescript", "react", "node", "next.js", "nextjs", "c++", "c#", "golang", "rust", "sql", "html", "css", "php",
    "django", "flask", "fastapi", "express", "spring", "angular", "vue", "api", "endpoint", "function", "class", "script", "program", "component",
    "frontend", "backend", "server", "client", "database", "db", "schema", "diagram", "er ", "table", "auth", "authentication", "login", "signup",
    "dashboard", "payment", "gateway", "navbar", "ui", "button", "form", "deploy", "docker", "kubernetes", "microservice", "website", "web app",
    "webapp", "app", "application", "system", "platform", "crud", "route",
)
DEBUG_MARKERS = ("fix", "debug", "bug", "error", "exception", "crash", "broken", "not working")
CREATIVE_MARKERS = ("story", "poem", "poetry", "haiku", "song", "lyrics", "novel", "screenplay")
CONTINUATION_VERBS = "add also now continue fix improve expand optimize refactor update change generate create build develop design implement deploy make extend enhance integrate".split()

# Intents -----------------------------------------------------------------------------------------
INTENTS = ("coding", "debugging", "reasoning", "education", "mathematics", "summarization", "translation", "creative_writing", "document_analysis", "research", "conversation", "general_chat")
CHITCHAT = ("tell me a joke", "who are you", "what can you do", "how are you", "your name", "make me laugh", "let's chat", "lets chat")
BUILD_VERBS = ("build", "create", "develop", "design", "architect", "engineer", "implement", "make", "generate", "code", "program", "produce", "set up")
SYSTEM_NOUNS = (
    "website", "web site", "webapp", "web app", "application", "app", "system", "platform", "service", "microservice", "microservices",
    "dashboard", "engine", "framework", "pipeline", "saas", "product", "portal", "marketplace", "clone", "e-commerce", "ecommerce",
    "social network", "social media", "game", "chatbot", "bot", "builder", "management system", "crm", "erp", "backend", "full stack",
    "full-stack", "operating system", "compiler", "database system", "recommendation system", "search engine", "streaming",
)
SCALE_MARKERS = (
    "scalable", "distributed", "production", "production-grade", "enterprise", "end-to-end", "end to end", "high availability", "fault tolerant",
    "real-time", "multi-tenant", "load balanc", "kubernetes", "cloud-native",
)
SMALL_ARTIFACTS = (
    "function", "program", "script", "snippet", "method", "class", "regex", "query", "endpoint", "api", "component", "form", "page",
    "algorithm", "cli", "command", "utility", "wrapper", "parser",
)
LONG_SOURCES = (
    "paper", "research paper", "document", "article", "essay", "book", "chapter", "report", "thesis", "dissertation", "transcript", "pdf",
    "contract", "manuscript", "novel", "blog post", "codebase", "repository",
)
TRIVIAL_CODE = ("hello world", "print statement", "one-liner", "one liner")
CODE_LANGUAGES = (
    "python", "java", "javascript", "typescript", "react", "node", "nextjs", "next.js", "c++", "c#", "golang", "rust", "sql", "html",
    "css", "php", "ruby", "swift", "kotlin", "flask", "django", "fastapi", "express", "spring", "angular", "vue", "tailwind",
)

# Files -------------------------------------------------------------------------------------------
IGNORED_DIRECTORIES = (
    ".git .hg .svn node_modules .next .nuxt .svelte-kit dist build coverage .cache .parcel-cache .turbo target out bin obj venv .venv env "
    "__pycache__ .pytest_cache .mypy_cache .ruff_cache .tox .gradle .idea .vscode .dart_tool .angular .expo vendor Pods DerivedData"
).split()
IGNORED_NAMES = ".ds_store thumbs.db package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock composer.lock cargo.lock".split()
BINARY_EXTENSIONS = (
    ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .svgz .woff .woff2 .ttf .otf .eot .mp3 .mp4 .mov .avi .mkv .wav .flac .ogg .webm "
    ".zip .tar .gz .tgz .rar .7z .bz2 .xz .pyc .pyo .so .dll .dylib .exe .bin .class .jar .war .o .a .lib .wasm .node "
    ".pdf .doc .docx .xls .xlsx .ppt .pptx .db .sqlite .sqlite3 .dat .pack .idx"
).split()
MAX_FILE_BYTES = 2 * 1024 * 1024
SNIFFED_BYTES = 4096
LANGUAGES = {
    "python": ".py .pyi", "javascript": ".js .mjs .cjs", "jsx": ".jsx", "typescript": ".ts .mts .cts", "tsx": ".tsx", "java": ".java",
    "kotlin": ".kt .kts", "go": ".go", "rust": ".rs", "csharp": ".cs", "dart": ".dart", "html": ".html .htm", "css": ".css .less",
    "scss": ".scss .sass", "vue": ".vue", "svelte": ".svelte", "json": ".json .jsonc", "markdown": ".md .markdown", "yaml": ".yaml .yml",
    "xml": ".xml", "toml": ".toml", "shell": ".sh .bash", "sql": ".sql",
}
CONFIG_NAMES = (
    "package.json tsconfig.json jsconfig.json next.config.js next.config.mjs next.config.ts nuxt.config.js nuxt.config.ts vite.config.js vite.config.ts "
    "webpack.config.js babel.config.js .babelrc angular.json vue.config.js tailwind.config.js tailwind.config.ts postcss.config.js requirements.txt "
    "pyproject.toml setup.py setup.cfg pipfile manage.py pom.xml build.gradle build.gradle.kts settings.gradle pubspec.yaml cargo.toml go.mod go.sum "
    "dockerfile docker-compose.yml docker-compose.yaml .env .env.example"
).split()

# Frameworks: name, category, npm packages, Python packages, marker manifests, (manifest, needle) ---
FRAMEWORKS = (
    ("Next.js", "fullstack", ("next",), (), (), ()),
    ("React", "frontend", ("react", "react-dom"), (), (), ()),
    ("Vue", "frontend", ("vue",), (), (), ()),
    ("Angular", "frontend", ("@angular/core",), (), (), ()),
    ("Svelte", "frontend", ("svelte",), (), (), ()),
    ("Express", "backend", ("express",), (), (), ()),
    ("NestJS", "backend", ("@nestjs/core",), (), (), ()),
    ("Node", "backend", (), (), ("package.json",), ()),
    ("FastAPI", "backend", (), ("fastapi",), (), ()),
    ("Django", "backend", (), ("django",), (), ()),
    ("Flask", "backend", (), ("flask",), (), ()),
    ("Spring Boot", "backend", (), (), (), (("pom.xml", "spring-boot"), ("build.gradle", "spring-boot"), ("build.gradle.kts", "spring-boot"))),
    ("Flutter", "mobile", (), (), ("pubspec.yaml",), (("pubspec.yaml", "flutter"),)),
    ("Go", "language", (), (), ("go.mod",), ()),
    ("Rust", "language", (), (), ("cargo.toml",), ()),
)
DEPENDENCY_CONFIDENCE, MARKER_CONFIDENCE, MANIFEST_CONFIDENCE = 0.9, 0.6, 0.85

# Retrieval ---------------------------------------------------------------------------------------
TYPE_WEIGHTS = {
    "component": 1.20, "context_provider": 1.18, "class": 1.15, "dataclass": 1.12, "function": 1.10, "async_function": 1.10, "method": 1.08,
    "hook": 1.12, "utility_function": 1.05, "interface": 1.05, "type_alias": 1.02, "enum": 1.02, "record": 1.05, "struct": 1.05, "trait": 1.05,
    "config_file": 0.95, "module_constants": 0.9, "module": 0.85, "document": 0.8, "markup": 0.8, "style": 0.8, "data": 0.8, "block": 0.75,
}
DEPTH_DECAY, EXPANDED_FLOOR = 0.82, 0.35
UTILITY_TYPES = ("utility_function", "module_constants", "module")

# Providers ---------------------------------------------------------------------------------------
FAILOVER = ("groq", "gemini", "cloudflare", "ollama")
PROVIDER_LABELS = {"gemini": "Google Gemini", "groq": "Groq", "cloudflare": "Cloudflare Workers AI", "ollama": "Ollama"}
PREFERRED_MODELS = {
    "gemini": ("gemini-2.5-pro", "gemini-2.5-flash", "gemini-2.0-flash", "gemini-2.0-flash-001", "gemini-2.0-flash-lite", "gemini-1.5-pro", "gemini-1.5-flash"),
    "groq": ("llama-3.3-70b-versatile", "llama-3.1-70b-versatile", "llama-3.1-8b-instant", "llama3-70b-8192", "llama3-8b-8192", "mixtral-8x7b-32768", "gemma2-9b-it"),
    "cloudflare": ("@cf/meta/llama-3.1-8b-instruct", "@cf/meta/llama-3-8b-instruct", "@cf/mistral/mistral-7b-instruct-v0.1", "@cf/google/gemma-7b-it"),
    "ollama": ("qwen3:4b", "llama3.2:3b", "qwen2.5-coder:7b"),
}
CONFIG_HINTS = ("config", "package.json", ".env", "tsconfig", "requirements", "pyproject", "dockerfile")

# Languages with a parser, parts of model names that a provider's list is cleared of, confidences as words.
PARSED_LANGUAGES = ("python", "javascript", "jsx", "typescript", "tsx", "java", "go", "rust", "csharp")
UNSUITED_MODELS = {
    "gemini": ("embedding", "vision", "aqa", "experimental", "audio"),
    "groq": ("whisper", "embedding"),
    "cloudflare": ("translation", "vision", "embedding"),
    "ollama": ("embed",),
}
CONFIDENCE_WORDS = {"low": 0.4, "medium": 0.7, "high": 0.9}
DEFAULT_CONFIDENCE = 0.7
