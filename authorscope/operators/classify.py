"""Content type and language of a file, from its path only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import any_of

# ---- fixed values: extensions and names that decide the type ----
CODE_EXTENSIONS = (
    ".py", ".pyx", ".pxd", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".html", ".htm", ".css", ".scss",
    ".sass", ".less", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".java", ".kt", ".kts", ".scala",
    ".groovy", ".cs", ".fs", ".vb", ".go", ".rs", ".rb", ".rake", ".php", ".swift", ".m", ".mm", ".sh", ".bash",
    ".zsh", ".fish", ".lua", ".pl", ".pm", ".r", ".jl", ".ex", ".exs", ".elm", ".clj", ".cljs", ".erl", ".hrl",
    ".hs", ".lhs", ".ml", ".mli", ".nim", ".cr", ".v", ".zig", ".d",
)
DOC_EXTENSIONS = (
    ".md", ".markdown", ".rst", ".txt", ".adoc", ".asciidoc", ".tex", ".org", ".wiki", ".rdoc",
)
CONFIG_EXTENSIONS = (
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".properties", ".env", ".editorconfig",
    ".prettierrc", ".eslintrc", ".babelrc",
)
DATA_EXTENSIONS = (".csv", ".tsv", ".sql", ".sqlite", ".db")
DOC_FILENAMES = (
    "readme", "readme.md", "readme.txt", "readme.rst", "changelog", "changelog.md", "changes", "history",
    "contributing", "contributing.md", "contributors", "license", "license.md", "license.txt", "authors",
    "authors.md", "credits", "code_of_conduct", "code_of_conduct.md", "security", "security.md", "support",
    "support.md", "todo", "todo.md", "todo.txt", "faq", "faq.md",
)
CONFIG_FILENAMES = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "tsconfig.json", "jsconfig.json",
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "pipfile", "pipfile.lock", "poetry.lock",
    "cargo.toml", "cargo.lock", "gemfile", "gemfile.lock", "go.mod", "go.sum", "composer.json", "composer.lock",
    "makefile", "cmakelists.txt", "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".gitignore",
    ".gitattributes", ".gitmodules", ".dockerignore", ".npmignore", ".eslintrc.js", ".eslintrc.json",
    ".eslintrc.yml", ".prettierrc", ".prettierrc.js", ".prettierrc.json", "webpack.config.js", "vite.config.js",
    "rollup.config.js", "jest.config.js", "vitest.config.js", "terraform.tfvars", "variables.tf", "main.tf",
)
DOC_DIRECTORIES = ("docs", "doc", "documentation", "wiki")
CONFIG_DIRECTORIES = (".github", ".circleci", ".gitlab")
DOC_NAME_PARTS = ("readme", "changelog", "license", "contributing", "authors")
LANGUAGES = {
    "python": (".py", ".pyx"),
    "javascript": (".js", ".jsx"),
    "typescript": (".ts", ".tsx"),
    "java": (".java",),
    "kotlin": (".kt",),
    "go": (".go",),
    "rust": (".rs",),
    "ruby": (".rb",),
    "php": (".php",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".hpp"),
    "csharp": (".cs",),
    "swift": (".swift",),
    "bash": (".sh", ".bash"),
    "lua": (".lua",),
    "r": (".r",),
    "sql": (".sql",),
    "html": (".html",),
    "css": (".css",),
    "scss": (".scss",),
}
# ---- end of fixed values ----


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension(name: Column) -> Column:
    """Text from the last dot; empty when the only dot leads the name or ends it."""
    return F.regexp_extract(name, r"(?s)[^.].*?(\.[^.]+)$", 1)


def has_part(path: Column, names: tuple[str, ...]) -> Column:
    """Any path part, the file name included, equals one of ``names``."""
    return F.arrays_overlap(F.split(F.lower(path), "/", -1), F.array(*[F.lit(n) for n in names]))


def likely_config(path: Column) -> Column:
    name = file_name(path)
    dotfile = name.startswith(".") & ~name.startswith("..")
    rc_file = name.endswith("rc") & (F.length(name) > 2)
    return dotfile | has_part(path, CONFIG_DIRECTORIES) | rc_file


def likely_doc(path: Column) -> Column:
    name = file_name(path)
    return any_of([name.contains(p) for p in DOC_NAME_PARTS])


def content_type(path: Column) -> Column:
    """First matching test wins."""
    name = file_name(path)
    ext = extension(name)
    return (
        F.when(name.isin(*DOC_FILENAMES), "documentation")
        .when(name.isin(*CONFIG_FILENAMES), "configuration")
        .when(ext.isin(*DOC_EXTENSIONS) & has_part(path, DOC_DIRECTORIES), "documentation")
        .when(ext.isin(*CODE_EXTENSIONS), "code")
        .when(ext.isin(*DOC_EXTENSIONS), "documentation")
        .when(ext.isin(*CONFIG_EXTENSIONS), "configuration")
        .when(ext.isin(*DATA_EXTENSIONS), "data")
        .when(likely_config(path), "configuration")
        .when(likely_doc(path), "documentation")
        .otherwise("unknown")
    )


def language(path: Column) -> Column:
    """Programming language by extension, null when not listed."""
    ext = extension(file_name(path))
    out = None
    for name, extensions in LANGUAGES.items():
        hit = ext.isin(*extensions)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
