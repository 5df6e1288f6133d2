"""Directories and repositories as tables of files: ignore rules, globs, the size guard and the tree text."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.matchers import binary as looks_binary
from docloom.functions.text import file_size
from docloom.operators.fold import ordered_join
from docloom.sources import files

#: Patterns of the two named modes.
STANDARD = (
    ".*", ".*/.*", ".git", ".git/*", "**/.git/*", "__pycache__", "__pycache__/*", "**/__pycache__/*", "*.pyc", "*.pyo", "*.pyd",
    ".venv", ".venv/*", "**/.venv/*", "venv", "venv/*", "**/venv/*", "env", "env/*", "**/env/*", "node_modules", "node_modules/*",
    "**/node_modules/*", ".env", ".env.*", "*.log", "*.tmp", "*.cache", ".DS_Store", "Thumbs.db", "dist", "build", "target",
    ".idea", ".vscode", ".pytest_cache", ".coverage", "*.egg-info", "*.dist-info",
)
MINIMAL = (".git", ".git/*", "**/.git/*", "__pycache__", "__pycache__/*", "**/__pycache__/*", "*.pyc", "*.pyo", "*.pyd", ".DS_Store", "Thumbs.db")
#: Endings that count as binary unread, and the size beyond which a directory is only described.
BINARY_ENDINGS = (".exe", ".dll", ".so", ".dylib", ".bin", ".obj", ".o", ".a", ".lib", ".pyc", ".pyo", ".class", ".jar", ".war", ".ear", ".zip")
SIZE_LIMIT = 500 * 1024 * 1024


def _file_patterns(base: str, name: str) -> list[str] | None:
    try:
        with open(os.path.join(base, name), encoding="utf-8") as f:
            return [s for line in f if (s := line.strip()) and not s.startswith("#")]
    except OSError:
        return None


def ignore_patterns(base: str, mode: str) -> list[str]:
    """Of a mode (standard, minimal, gitignore, attachmentsignore, auto), or a comma list; empty for none."""
    named = {"gitignore": ".gitignore", "attachmentsignore": ".attachmentsignore"}
    if mode == "standard":
        return list(STANDARD)
    if mode == "minimal":
        return list(MINIMAL)
    if mode in named:
        return _file_patterns(base, named[mode]) or []
    if mode == "auto":
        found = (_file_patterns(base, n) for n in (".attachmentsignore", ".gitignore"))
        return next((p for p in found if p is not None), list(STANDARD))
    return [p.strip() for p in mode.split(",")] if mode else []


def _like(pattern: str) -> str:
    """A shell pattern as a Java regular expression for the whole string."""
    return r"\A" + fnmatch.translate(pattern).replace(r"\Z", r"\z")


def ignored(rel: Column, patterns: list[str]) -> Column:
    """Whether a path below the base, or a directory above it, falls under a pattern."""
    name, out = F.regexp_extract(rel, r"([^/]*)\z", 1), F.lit(False)
    for p in patterns:
        one = rel.rlike(_like(p)) | name.rlike(_like(p))
        if p.endswith("/"):
            one = one | rel.startswith(p)
        if "**" in p:
            one = one | rel.rlike(_like(p.replace("**/", "*/")))
        out = out | one
    return out


def pruned(rel: Column, patterns: list[str]) -> Column:
    """Ignored itself or below an ignored directory."""
    if not patterns:
        return F.lit(False)
    steps = F.split(rel, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return F.exists(above, lambda p: ignored(p, patterns))


def in_glob(rel: Column, glob: str) -> Column:
    name, out = F.regexp_extract(rel, r"([^/]*)\z", 1), F.lit(False)
    for p in (x.strip() for x in glob.split(",")):
        out = out | name.rlike(_like(p)) | rel.rlike(_like(p))
    return out


def listing(spark: SparkSession, base: str, ignore: str = "standard", glob: str = "", recursive: bool = True, max_files: int = 1000, include_binary: bool = False) -> DataFrame:
    """path, rel, length, modificationTime of the files kept, the first ``max_files`` in path order.

    The binary test looks at the first KiB, but the scan reads a file whole: ``include_binary`` reads no content at all."""
    base = os.path.abspath(base)
    rows = files.binary(spark, base, recursive=recursive)
    rel = F.regexp_replace(F.col("path"), "^(file:/*|" + re.escape("file:" + base) + ")", "/")
    rows = rows.withColumn("rel", F.regexp_replace(rel, "^" + re.escape(base.rstrip("/") + "/"), ""))
    rows = rows.filter(~pruned(F.col("rel"), ignore_patterns(base, ignore)))
    if glob:
        rows = rows.filter(in_glob(F.col("rel"), glob))
    if not include_binary:
        ends = F.lit(False)
        for e in BINARY_ENDINGS:
            ends = ends | F.lower("rel").endswith(e)
        rows = rows.filter(~ends & ~looks_binary(F.col("content")))
    return rows.select("path", "rel", "length", "modificationTime").orderBy("rel").limit(max_files)


def size_guard(listed: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """One row: file_count, total_size, too_large and the text that says so."""
    g = listed.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"))
    mb = F.format_string("%.1f MB", F.col("total_size") / 1048576.0)
    said = F.concat(F.lit("## Size Warning\n\n**Total Size**: "), mb, F.lit(" ("), F.format_number("file_count", 0), F.lit(f" files)\n**Size Limit**: {limit // 1048576} MB\n\n🚨 **This directory is too large to process automatically.**\n\n"))
    return g.withColumns({"too_large": F.col("total_size") > limit, "text": F.when(F.col("total_size") > limit, said)})


def directory_map(listed: DataFrame, base: str) -> DataFrame:
    """One text: base path, number of files and the list, in path order."""
    line = F.concat(F.lpad(file_size(F.col("length")), 8, " "), F.lit(" "), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "rel", F.lit("\n"))
    g = listed.agg(F.count(F.lit(1)).cast("string").alias("n"), ordered_join(F.struct("rel"), line, "").alias("body"))
    top = f"## Directory Map\n\n**Base Path**: `{base}`\n\n**Files Found**: "
    return g.select(F.concat(F.lit(top), "n", F.lit("\n\n"), F.when(F.length("body") > 0, F.concat(F.lit(f"```\n{'Size':<8} {'Modified':<19} File\n{'-' * 8} {'-' * 19} {'-' * 40}\n"), "body", F.lit("```\n\n"))).otherwise(F.lit(""))).alias("text"))


def tree_lines(names: list[str]) -> list[str]:
    """Tree drawing of relative paths: directories first, then files, each by lower-case name."""
    root: dict = {}
    for name in names:
        at = root
        *above, last = name.split("/")
        for d in above:
            at = at.setdefault(d, {})
        at.setdefault(last, None)

    def draw(node: dict, prefix: str) -> list[str]:
        items = sorted(node.items(), key=lambda kv: (kv[1] is None, kv[0].lower()))
        out = []
        for i, (name, below) in enumerate(items):
            last = i == len(items) - 1
            out.append(f"{prefix}{'└── ' if last else '├── '}{name}{'' if below is None else '/'}")
            if below:
                out += draw(below, prefix + ("    " if last else "│   "))
        return out

    return draw(root, "")


def structure(listed: DataFrame, base: str) -> str:
    """The tree of a listing. It is one text of at most ``max_files`` names, so the driver draws it."""
    names = [r["rel"] for r in listed.select("rel").orderBy("rel").toLocalIterator()]
    top = os.path.basename(os.path.abspath(base))
    return "\n".join([f"# Directory: {top}", "", "## Directory Structure", "", "```", f"{top}/", *tree_lines(names), "```", "", ""])


def is_directory(path: str) -> bool:
    return os.path.isdir(os.path.abspath(path))


def is_repository(path: str) -> bool:
    return os.path.exists(os.path.join(os.path.abspath(path), ".git"))


def glob_base(pattern: str) -> str:
    """The directory above the first part with a glob character."""
    kept = []
    for part in pattern.split(os.sep):
        if re.search(r"[*?\[\]]", part):
            break
        kept.append(part)
    return os.sep.join(kept) or (os.sep if pattern.startswith(os.sep) else os.getcwd())


def glob_listing(spark: SparkSession, pattern: str, max_files: int = 1000) -> DataFrame:
    """Files that a path pattern names, binary ones left out."""
    base = os.path.abspath(glob_base(pattern))
    rel = os.path.relpath(os.path.abspath(pattern), base)
    every = listing(spark, base, "", "", True, 1 << 30)
    whole = re.escape(os.sep).join(("(?:.*)" if p == "**" else fnmatch.translate(p).replace(".*", "[^/]*").replace(r"\Z", "")) for p in rel.split(os.sep)).replace("(?:.*)/", "(?:.*/)?")
    return every.filter(F.col("rel").rlike(rf"\A{whole}\z")).orderBy("rel").limit(max_files)


def git_metadata(base: str) -> dict[str, str]:
    """Branch, remote and last commit as git tells them; empty where it cannot."""
    asks = {"current_branch": ("rev-parse", "--abbrev-ref", "HEAD"), "remote_url": ("config", "--get", "remote.origin.url"), "last_commit": ("log", "-1", "--format=%h - %s"), "author": ("log", "-1", "--format=%an (%ad)"), "commit_count": ("rev-list", "--count", "HEAD")}
    out = {}
    for key, args in asks.items():
        try:
            done = subprocess.run(["git", "-C", base, *args], capture_output=True, text=True, timeout=10, check=True)
        except (OSError, subprocess.SubprocessError):
            continue
        if done.stdout.strip():
            out[key] = done.stdout.strip()
    return out


def repository(spark: SparkSession, base: str, **options) -> tuple[DataFrame, dict[str, str]]:
    return listing(spark, base, **options), git_metadata(base)


def repository_text(listed: DataFrame, base: str) -> str:
    """Branch, remote, last commit and tree."""
    known, top = git_metadata(base), os.path.basename(os.path.abspath(base))
    names = {"current_branch": "Branch", "remote_url": "Remote", "last_commit": "Last Commit", "author": "Author", "commit_count": "Total Commits"}
    said = [f"**{name}**: {known[key]}" for key, name in names.items() if key in known]
    tree = structure(listed, base).split("## Directory Structure", 1)[1]
    return "\n".join([f"# Git Repository: {top}", "", "## Repository Information", "", *said, "", "## Directory Structure"]) + tree
