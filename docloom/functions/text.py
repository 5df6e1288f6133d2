"""String rules shared by the operators, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware string methods see it; Java's own class is ASCII only.
W = r"[\s\u001c-\u001f\u0085\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{W}+|{W}+\z", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """With its dot, lower case; dot files have none."""
    return F.lower(F.regexp_extract(basename(path), r"\A\.*[^.].*?(\.[^.]*)\z", 1))


def file_size(n: Column) -> Column:
    """Bytes as 12.0B, 1.5KB, ... TB, one decimal; exact halves go to the even digit."""
    n = n.cast("double")
    said = lambda v, unit: F.format_string(f"%.1f{unit}", F.bround(v, 1))
    out = said(n / 1024.0**4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n / 1024.0**power < 1024, said(n / 1024.0**power, unit)).otherwise(out)
    return F.when(n.isNotNull(), out)


#: Language names by file extension.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JSX", ".tsx": "TSX", ".java": "Java", ".c": "C",
    ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".h": "C Header", ".hpp": "C++ Header", ".cs": "C#", ".php": "PHP",
    ".rb": "Ruby", ".go": "Go", ".rs": "Rust", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".sh": "Shell",
    ".bash": "Bash", ".zsh": "Zsh", ".fish": "Fish", ".ps1": "PowerShell", ".html": "HTML", ".htm": "HTML", ".css": "CSS",
    ".scss": "SCSS", ".sass": "Sass", ".less": "Less", ".xml": "XML", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".toml": "TOML", ".ini": "INI", ".cfg": "Config", ".conf": "Config", ".md": "Markdown", ".rst": "reStructuredText",
    ".txt": "Text", ".sql": "SQL", ".r": "R", ".m": "MATLAB", ".pl": "Perl", ".lua": "Lua", ".vim": "Vim Script",
    ".dockerfile": "Dockerfile", ".makefile": "Makefile", ".cmake": "CMake", ".gradle": "Gradle", ".maven": "Maven", ".sbt": "SBT",
}


def upper(s: str) -> str:
    """Upper case letter for letter, as SQL has it: letters whose upper case is several stay as they are, or take their
    title case where that is one letter."""
    return "".join(u if len(u := c.upper()) == 1 else "\u1e9e" if c == "ß" else t if len(t := c.title()) == 1 else c for c in s)


#: Fixed value: characters of results that a worker gathers before it hands them on.
SLICE = 1 << 20


def in_slices(results: Iterable, array: Callable[[list], object], weight: Callable[[object], int]) -> Iterator:
    """Results of one batch as several small arrays, so that a worker holds few of them at a time."""
    held, size = [], 0
    for r in results:
        held.append(r)
        size += 64 + weight(r)
        if size >= SLICE:
            yield array(held)
            held, size = [], 0
    if held:
        yield array(held)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LANGUAGES), ext), F.lit(""))
