"""Small files to try things with, made by rule when asked for."""

from __future__ import annotations

import json
import os

ROWS = [(f"Person {k}", 20 + k, f"City {k % 3}") for k in range(5)]


def _pdf(lines: list[str]) -> bytes:
    show = b"BT " + b" 0 -12 Td ".join(b"(%s) Tj" % x.encode() for x in lines) + b" ET"
    objects = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R] /Count 1>>", b"<</Type /Page /Parent 2 0 R /Contents 4 0 R>>", b"<</Length %d>>\nstream\n%s\nendstream" % (len(show), show)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer <</Root 1 0 R>>\n"


SAMPLES = {
    "people.csv": lambda: ("name,age,city\n" + "".join(f"{a},{b},{c}\n" for a, b, c in ROWS)).encode(),
    "people.json": lambda: json.dumps([dict(zip(("name", "age", "city"), r)) for r in ROWS], indent=2).encode(),
    "notes.txt": lambda: "\n\n".join(f"Paragraph {k}. It has two sentences." for k in range(1, 5)).encode(),
    "page.html": lambda: b"<html><head><title>Sample</title></head><body><h1>Sample</h1><p>One paragraph.</p></body></html>",
    "page.pdf": lambda: _pdf(["A sample of one page", "with two lines of text that are long enough to count"]),
    "square.svg": lambda: b'<svg xmlns="http://www.w3.org/2000/svg" width="10" height="10"><rect width="10" height="10"/></svg>',
}


def sample_names() -> list[str]:
    return sorted(SAMPLES)


def sample_path(name: str, folder: str) -> str:
    """Write the sample into the folder and return its path; an unknown name raises KeyError."""
    data = SAMPLES[name]()
    os.makedirs(folder, exist_ok=True)
    at = os.path.join(folder, name)
    with open(at, "wb") as f:
        f.write(data)
    return at
