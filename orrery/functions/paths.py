"""Column expressions on project paths."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and suffixes that decide how a path is treated.
TEST_DIRS = ["tests", "test", "__tests__"]
ALWAYS_EXCLUDED = [
    ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".hypothesis", ".tox", ".eggs", "*.egg-info",
    "node_modules", ".venv", "venv", "env", ".env", ".gitignore", ".gitkeep", "target", "build", "dist", ".next", ".nuxt", ".svelte-kit",
    ".terraform", ".gradle", "coverage", "htmlcov", ".idea", ".vscode", ".orrery", ".orreryignore",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".mp3", ".mp4", ".avi", ".mov", ".zip", ".tar", ".gz", ".bz2", ".xz",
    ".whl", ".so", ".dll", ".dylib", ".o", ".pyc", ".pyo", ".db", ".sqlite", ".sqlite3", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]
SOURCE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".rb", ".go", ".rs", ".java", ".cs", ".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".hh", ".hxx", ".php"]
CONFIG_FILES = [
    "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "Gemfile", "Makefile", "Dockerfile", "docker-compose.yml", ".env.example", "README.md",
    "setup.py", "setup.cfg", "tsconfig.json", "next.config.js", "vite.config.js", "webpack.config.js", "tailwind.config.js", "postcss.config.js",
    "eslintrc.js", "prettier.config.js", "rust-toolchain", ".dockerignore", ".gitignore",
]
SECRET_EXTENSIONS = [".pem", ".key", ".crt", ".cert", ".p12", ".pfx", ".jks", ".keystore", ".cer", ".ppk", ".env"]
SECRET_NAMES = ["env.local", "env.production", "env.staging", "env.secret"]
SECRET_GLOBS = ["*secrets*", "*secret*", "*credentials*", "*private*", "*password*", "*token*", "*api*key*", "*auth*key*"]
NEVER_READ = ["id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "id_ecdsa_sk", "id_ed25519_sk", ".netrc", "_netrc", ".pgpass", ".htpasswd", ".npmrc", ".yarnrc", ".yarnrc.yml", ".pypirc", ".flaskenv"]
ENV_TEMPLATES = ["example", "sample", "template", "dist"]
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".rs": "rust", ".cs": "csharp",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".go": "go", ".php": "php",
}


def norm_path(p: Column) -> Column:
    """Forward slashes, no leading ``./`` (however often)."""
    return F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def directory(p: Column) -> Column:
    """The parent; empty for a path without one."""
    return F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)


def collapse(p: Column) -> Column:
    """The parent directory; a file at the root stands for itself."""
    return F.regexp_replace(p, r"/[^/]*$", "")


def extension(p: Column) -> Column:
    """From the last dot of the path on, in lower case; empty without one."""
    return F.regexp_extract(F.lower(p), r"(\.[^.]*)$", 1)


def suffix(p: Column) -> Column:
    """Like :func:`extension`, but of the name only: a leading dot starts none."""
    return F.regexp_extract(F.lower(basename(p)), r"^.+?(\.[^.]+)$", 1)


def language(p: Column) -> Column:
    """Language by suffix, or null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, suffix(p))


def is_test(p: Column) -> Column:
    parts = F.split(F.lower(F.replace(p, F.lit("\\"), F.lit("/"))), "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | stem.startswith("test_") | stem.endswith("_test") | (stem == "test") | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec."))


def glob_regex(pattern: str) -> str:
    """A glob (``*`` crosses slashes) as an anchored Java pattern."""
    return "^(?:" + re.sub(r"\\z$|\\Z$", "", fnmatch.translate(pattern)) + ")$"


def _in(c: Column, values: list[str]) -> Column:
    return c.isin(*values) if values else F.lit(False)


def excluded(p: Column, patterns: list[str]) -> Column:
    """Names match any component, names with a slash the whole path, globs either."""
    globs = [x for x in patterns if any(c in x for c in "*?[")]
    exact = [x for x in patterns if x not in globs]
    parts = F.split(p, "/")
    out = _in(p, exact) | F.arrays_overlap(parts, F.array(*map(F.lit, [x for x in exact if "/" not in x])).cast("array<string>"))
    for rx in map(glob_regex, globs):
        out = out | p.rlike(rx) | F.exists(parts, _matcher(rx))
    return out


def _matcher(pattern: str):
    return lambda x: x.rlike(pattern)


def is_binary(p: Column) -> Column:
    return suffix(p).isin(*BINARY_EXTENSIONS)


def is_sensitive(p: Column) -> Column:
    """Names of files that may hold secrets and are never read."""
    name = F.lower(basename(p))
    ext, stem = suffix(p), F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    q = lambda xs: "|".join(map(re.escape, xs))
    backups = name.rlike(rf"^(?:{q(NEVER_READ)})(?:[.-].*|~)$") & ~name.endswith(".pub")
    of_ext = name.rlike(rf"(?:{q(SECRET_EXTENSIONS)}|\.env\.(?:local|production|staging|dev|secret|override))(?:\.bak|\.old|~|-orig)$")
    hashed = name.rlike(rf"^#(?:{q(NEVER_READ)})#$") | name.rlike(rf"^#.+(?:{q(SECRET_EXTENSIONS)})#$")
    template = name.rlike(rf"\.env\.(?:{'|'.join(ENV_TEMPLATES)})$")
    env = (name.startswith(".env") | name.endswith(".env") | F.contains(name, F.lit(".env."))) & ~template
    by_name = F.lit(False)
    for g in SECRET_GLOBS:
        by_name = by_name | stem.rlike(glob_regex(g)) | name.rlike(glob_regex(g))
    return _in(ext, SECRET_EXTENSIONS) | _in(name, [*SECRET_EXTENSIONS, *SECRET_NAMES, *NEVER_READ]) | backups | of_ext | hashed | env | (by_name & ~ext.isin(*SOURCE_EXTENSIONS))


def priority(p: Column) -> Column:
    """Rank by which files are kept under a limit; lower goes first.

    The lower-cased path is compared with the configuration names as they are written, so mixed-case names never match.
    """
    low = F.lower(p)
    return (
        F.when(low.isin(*CONFIG_FILES), 0)
        .when(low.endswith("/__init__.py") | low.endswith("/__init__.js"), 1)
        .when(low.endswith("/main.py") | low.endswith("/main.js"), 2)
        .when(is_test(p), 10)
        .when(suffix(p).isin(*SOURCE_EXTENSIONS), 5)
        .otherwise(8)
    )
