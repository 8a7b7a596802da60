"""Row filters and per-repo caps that run before any rule."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions import text as T
from ..plans.durable import durable
from .classify import content_type
from .topk import leading_rows

# ---- fixed values: git-style ignore patterns, hidden directories that stay, text bytes ----
IGNORE_PATTERNS = (
    "node_modules/", "vendor/", "venv/", ".venv/", "__pycache__/", "*.pyc", ".tox/", "bower_components/", "dist/",
    "build/", "target/", "out/", "*.egg-info/", ".idea/", ".vscode/", "*.swp", "*.swo", ".project", ".classpath",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.pdf", "*.zip", "*.tar", "*.gz", "*.woff", "*.woff2",
    "*.ttf", "*.eot", "*.mp3", "*.mp4", "*.webm", "*.mov", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "Pipfile.lock", "poetry.lock", "Cargo.lock", "Gemfile.lock", "composer.lock", "go.sum", ".git/", ".DS_Store",
    "Thumbs.db", "*.log", "*.min.js", "*.min.css", "*.map", "coverage/", ".coverage", ".nyc_output/",
)
KEPT_HIDDEN_DIRECTORIES = (".claude", ".cursor", ".aider", ".codeium", ".ai", ".copilot", ".github")
SNIFF_BYTES = 8192
NON_TEXT_CLASS = r"[\x00-\x06\x0b\x0e-\x1a\x1c-\x1f\x7f]"
# ---- end of fixed values ----


#: The bytes of the class above.
NON_TEXT_BYTES = bytes(b for b in range(256) if re.match(NON_TEXT_CLASS, chr(b)))

_GLOB_PARTS = re.compile(r"\[!?\]?[^\]/]*\]|\A\*\*/|/\*\*\Z|/\*\*/|.", re.DOTALL)
#: Any number of folders: before the rest, after it, or between two parts.
_ANY_FOLDERS = {"**/": "(?:[^/]*/)*", "/**": "/[^/]", "/**/": "/(?:[^/]*/)*"}


def _glob_part(part: str) -> str:
    if part in _ANY_FOLDERS:
        return _ANY_FOLDERS[part]
    if part in ("*", "?"):
        return "[^/]*" if part == "*" else "[^/]"
    if len(part) > 1:
        negated, body = part.startswith("[!"), part[1:-1].removeprefix("!")
        body = re.sub(r"([\[\]\\^&~])", r"\\\1", body)
        return f"[^/{body}]" if negated else f"[{body}]"
    return re.escape(part)


def negates(patterns: tuple[str, ...] | None) -> bool:
    return any(p.startswith("!") for p in patterns or ())


def ignore_regex(patterns: tuple[str, ...] | None = None) -> str:
    """One anchored regex for git-style names: ``name/`` drops a subtree, ``name`` a file or subtree.

    Supports ``*``, ``?``, bracket classes (``[co]``, ``[!a-z]``), ``**`` as a whole part of the path, and a slash at
    the start or inside, which ties the pattern to the root of the tree. Negated patterns need :func:`ignored`.
    """
    directories, names, rooted = [], [], []
    for pattern in patterns or IGNORE_PATTERNS:
        if pattern.startswith("!"):
            raise ValueError(f"a negated pattern has no regex of its own, got {pattern!r}")
        name = pattern.rstrip("/")
        body = "".join(_glob_part(part) for part in _GLOB_PARTS.findall(name.removeprefix("/")))
        if pattern.endswith("/**"):
            rooted.append(body)
        elif "/" in name:
            rooted.append(body + ("/" if pattern.endswith("/") else "(?:/|\\z)"))
        else:
            (directories if pattern.endswith("/") else names).append(body)
    alternatives = []
    if directories:
        alternatives.append(f"(?:{'|'.join(directories)})/")
    if names:
        alternatives.append(f"(?:{'|'.join(names)})(?:/|\\z)")
    anywhere = [f"(?:^|/)(?:{'|'.join(alternatives)})"] if alternatives else []
    return "|".join(anywhere + ([f"^(?:{'|'.join(rooted)})"] if rooted else []))


def ignored(path: Column, patterns: tuple[str, ...] | None = None) -> Column:
    """The last pattern that matches decides; ``!pattern`` takes a path back. Neighbours of one kind are one regex."""
    verdict = F.lit(False)
    for negated, some in itertools.groupby(patterns or IGNORE_PATTERNS, key=lambda p: p.startswith("!")):
        hit = path.rlike(ignore_regex(tuple(p.removeprefix("!") for p in some)))
        verdict = verdict & ~hit if negated else verdict | hit
    return verdict


def in_hidden_directory(path: Column) -> Column:
    """Some directory part starts with a dot and is not in the kept list. Hidden files are fine."""
    parts = F.split(path, "/", -1)
    directories = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(
        directories, lambda d: d.startswith(".") & ~F.lower(d).isin(list(KEPT_HIDDEN_DIRECTORIES))
    )


def within_size(size: Column, limit: int | None) -> Column:
    return F.lit(True) if limit is None else size <= limit


def looks_binary(content: Column, sniff_bytes: int | None = SNIFF_BYTES) -> Column:
    """NUL in the first bytes (``None``: in the whole content), or more than 30 % of them outside the text set. Null
    content counts as binary.

    Latin-1 maps each byte to one character, so the byte test becomes a character-class count in the JVM.
    """
    start = content if sniff_bytes is None else F.substring(content, 1, sniff_bytes)
    head, size = F.decode(start, "ISO-8859-1"), F.octet_length(start)
    non_text = F.regexp_count(head, F.lit(NON_TEXT_CLASS))
    return F.when(content.isNull(), True).when(size == 0, False).otherwise(
        head.rlike(r"\x00") | (non_text / size > 0.3)
    )


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, Latin-1 otherwise; CRLF and CR become LF."""
    decoded = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return normalise_newlines(decoded)


def normalise_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def select_files(files: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """Drop ignored, hidden and oversized files. Reads ``path`` and ``size`` only."""
    return files.where(
        within_size(F.col("size"), config.max_file_size)
        & ~ignored(F.col("path"), config.ignore_patterns)
        & ~in_hidden_directory(F.col("path"))
    )


def file_cutoffs(files: DataFrame, max_files: int) -> DataFrame:
    """The last path kept in each repo that has more than ``max_files`` files. Reads ``repo`` and ``path`` only."""
    return (
        leading_rows(files.select("repo", "path"), ["repo"], ["path"], max_files + 1)
        .groupBy("repo")
        .agg(
            F.max(F.when(F.col("rank") == max_files, F.col("path"))).alias("last_path"),
            F.max("rank").alias("n"),
        )
        .where(F.col("n") > max_files)
        .select("repo", "last_path")
    )


def cap_files(files: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """Keep the first ``max_files`` files of each repo in path order. Paths are unique within a repo.

    Contents are never shuffled for the ranking. The cut-off rows exist only for repos over the cap; they are written
    once, measured, and broadcast when small, else joined on ``repo`` (adaptive skew splitting applies).
    """
    if config.max_files is None:
        return files
    cutoffs = durable(file_cutoffs(files, config.max_files), "file-cutoffs")
    size = cutoffs.agg(
        F.coalesce(F.sum(F.octet_length("repo") + F.octet_length("last_path") + 32), F.lit(0)).alias("b")
    ).first()["b"]
    if size == 0:
        return files
    side = F.broadcast(cutoffs) if size <= config.broadcast_limit_bytes else cutoffs
    return (
        files.join(side, "repo", "left")
        .where(F.col("last_path").isNull() | (F.col("path") <= F.col("last_path")))
        .drop("last_path")
    )


def classified(files: DataFrame) -> DataFrame:
    """Add ``content_type`` and ``line_count``."""
    return files.withColumns(
        {"content_type": content_type(F.col("path")), "line_count": T.line_count(F.col("content"))}
    )


def eligible(files: DataFrame) -> DataFrame:
    """Non-empty, of a known type, at least five lines. Data files pass."""
    return files.where(
        (F.octet_length("content") > 0) & (F.col("content_type") != "unknown") & (F.col("line_count") >= 5)
    )


def repository_name(url: Column) -> Column:
    """owner/name for the three known hosts, else the last path part, else the URL itself."""
    candidates = [
        F.regexp_extract(url, rf"{host}[:/]([^/]+/[^/]+?)(?:\.git)?$", 1)
        for host in (r"github\.com", r"gitlab\.com", r"bitbucket\.org")
    ] + [F.regexp_extract(url, r"/([^/]+)/?$", 1)]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], url)


def is_remote(location: Column) -> Column:
    return location.rlike(r"^(?:http://|https://|git@)")
