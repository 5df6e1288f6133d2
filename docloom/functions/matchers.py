"""What a file is, by its path, its content type and the first bytes: one boolean Column each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of a URL that are files, not pages.
FILE_ENDINGS = (".pdf", ".pptx", ".ppt", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".zip", ".svg", ".svgz", ".eps", ".epsf", ".epsi", ".heic", ".heif", ".webp")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".heic", ".heif", ".webp")
TEXT_ENDINGS = (".txt", ".md", ".log", ".json", ".py", ".xml", ".html", ".htm", ".rst")
#: First bytes, in hexadecimal, that no text begins with.
BINARY_SIGNATURES = ("25504446", "504B", "FFD8FF", "89504E47", "47494638", "424D", "52494646")


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | path.endswith(e)
    return out


def _has(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


class File:
    """The three inputs; content_type and content may be missing."""

    def __init__(self, path: Column, content_type: Column | None = None, content: Column | None = None):
        self.path = path
        self.type = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
        self.content = content
        self.latin = F.decode(F.substring(content, 1, 2000), "ISO-8859-1") if content is not None else F.lit("")

    def starts(self, *hexes: str) -> Column:
        if self.content is None:
            return F.lit(False)
        head, out = F.hex(F.substring(self.content, 1, 16)), F.lit(False)
        for h in hexes:
            out = out | F.coalesce(head.startswith(h), F.lit(False))
        return out

    def within(self, *words: str) -> Column:
        return F.coalesce(_has(self.latin, words), F.lit(False)) if self.content is not None else F.lit(False)

    def sample(self, n: int) -> Column:
        """The first characters, as UTF-8 with replacement; empty without content."""
        if self.content is None:
            return F.lit("")
        return F.coalesce(F.left(F.make_valid_utf8(F.substring(self.content, 1, 4 * n).cast("string")), F.lit(n)), F.lit(""))


def url(f: File) -> Column:
    return f.path.rlike(r"\Ahttps?://")


def webpage(f: File) -> Column:
    return f.path.rlike(r"\Ahttps?://") & ~_ends(F.lower(f.path), FILE_ENDINGS)


def csv(f: File) -> Column:
    head = f.sample(200)
    return f.path.endswith(".csv") | f.type.contains("text/csv") | (head.contains("\n") & F.substring_index(head, "\n", 1).contains(","))


def pdf(f: File) -> Column:
    return f.path.endswith(".pdf") | f.type.contains("pdf") | f.starts("25504446")


def pptx(f: File) -> Column:
    return _ends(f.path, (".pptx", ".ppt")) | _has(f.type, ("powerpoint", "presentation")) | (f.starts("504B") & f.within("ppt/"))


def docx(f: File) -> Column:
    return _ends(f.path, (".docx", ".doc")) | _has(f.type, ("msword", "document", "wordprocessingml")) | (f.starts("504B") & f.within("word/"))


def excel(f: File) -> Column:
    return _ends(f.path, (".xlsx", ".xls")) | _has(f.type, ("excel", "spreadsheet")) | (f.starts("504B") & f.within("xl/"))


def image(f: File) -> Column:
    webp = f.starts("52494646") & (F.left(f.latin, F.lit(20)).contains("WEBP") if f.content is not None else F.lit(False))
    return _ends(F.lower(f.path), IMAGE_ENDINGS) | f.type.startswith("image/") | f.starts("FFD8FF", "89504E47", "47494638", "424D") | webp


def likely_text(f: File) -> Column:
    """Valid UTF-8 that begins with no known signature."""
    if f.content is None:
        return F.lit(False)
    return F.coalesce(F.is_valid_utf8(f.content.cast("string")) & ~f.starts(*BINARY_SIGNATURES), F.lit(False))


def text(f: File) -> Column:
    return _ends(f.path, TEXT_ENDINGS) | f.type.startswith("text/") | _has(f.type, ("json", "xml")) | likely_text(f)


def svg(f: File) -> Column:
    head = F.lower(f.sample(500))
    return _ends(F.lower(f.path), (".svg", ".svgz")) | f.type.contains("svg") | (head.contains("<svg") & head.contains("xmlns"))


def eps(f: File) -> Column:
    head = f.sample(200)
    return _ends(F.lower(f.path), (".eps", ".epsf", ".epsi")) | _has(f.type, ("postscript", "eps")) | head.startswith("%!PS-Adobe") | (head.contains("%%BoundingBox:") & head.contains("%!"))


def archive(f: File) -> Column:
    return F.lower(f.path).endswith(".zip") | (f.starts("504B") & ~f.within("word/", "ppt/", "xl/"))


def glob_pattern(f: File) -> Column:
    return f.path.rlike(r"[*?\[\]]")


def binary(content: Column) -> Column:
    """A null byte in, or no UTF-8 for, the first KiB."""
    head = F.substring(content, 1, 1024)
    return F.contains(head, F.unhex(F.lit("00"))) | ~F.is_valid_utf8(head.cast("string"))


MATCHERS = {"url": url, "webpage": webpage, "csv": csv, "pdf": pdf, "pptx": pptx, "docx": docx, "excel": excel, "image": image, "text": text, "svg": svg, "eps": eps, "zip": archive, "glob": glob_pattern}

#: The order in which a plan is chosen, and the loader chain's order for what is left.
PROCESSORS = ("pdf", "image", "docx", "pptx", "excel", "webpage", "csv", "svg", "eps")
NAMED_PROCESSORS = ("academic_pdf", "legal_pdf", "financial_pdf", "medical_pdf", "legal_docx")


def _first(f: File, names: tuple[str, ...], otherwise: Column) -> Column:
    out = otherwise
    for name in reversed(names):
        out = F.when(MATCHERS[name](f), F.lit(name)).otherwise(out)
    return out


def processor(f: File) -> Column:
    """The plan's name, ``universal`` where no rule fits."""
    return _first(f, PROCESSORS, F.lit("universal"))


def kind(f: File) -> Column:
    """What the loader chain makes of a file."""
    return _first(f, ("pdf", "image", "docx", "pptx", "excel", "webpage", "csv", "svg", "eps", "zip", "text"), F.lit(None).cast("string"))
