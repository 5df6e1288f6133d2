"""The high-level facade: files in, one prompt or one provider message out."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import dsl
from docloom.operators import adapt, fold
from docloom.plans import route, verbs
from docloom.schema import canonical
from docloom.sources import directories, files

#: How a prompt may name a file or a page.
REFERENCES = (
    r"\b([a-zA-Z0-9_.-]+\.[a-zA-Z0-9]+(?:\[[^\]]*\])?)\b",
    r'"([^"]+\.[a-zA-Z0-9]+(?:\[[^\]]*\])?)"',
    r"'([^']+\.[a-zA-Z0-9]+(?:\[[^\]]*\])?)'",
    r"`([^`]+\.[a-zA-Z0-9]+(?:\[[^\]]*\])?)`",
    r"(https?://[^\s\[\]]+(?:\[[^\]]*\])?)",
)


class Context:
    """``df`` is the processed table, made when first asked for and kept; the properties fold it."""

    def __init__(self, spark: SparkSession, *paths: str | list[str], prompt: str | None = None):
        flat = [p for x in paths for p in (x if isinstance(x, (list, tuple)) else [x])]
        self.spark, self.references, self.prompt = spark, flat, prompt
        self._df: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            parsed = canonical(files.attached(self.spark, self.references))
            described, plain = self._expanded(parsed.select("ord", "attachy", "path", "commands").collect())
            rows = canonical(self.spark.createDataFrame(plain, "ord long, attachy string, path string, commands map<string,string>"))
            done = route.processed(verbs.load.content(rows)) if plain else None
            if described:
                more = canonical(self.spark.createDataFrame(described, "ord long, attachy string, path string, commands map<string,string>, kind string, text string")).withColumn("processor", F.lit("directory")).select(*route.RENDERED)
                done = more if done is None else done.unionByName(more)
            splits = any("split" in r[3] for r in plain)
            split = (route.split_as_asked if splits else route.unsplit)(done if done is not None else rows.withColumn("processor", F.lit("universal")).select(*route.RENDERED))
            self._df = split.persist()  # each property folds it anew
        return self._df

    def _expanded(self, rows) -> tuple[list[tuple], list[tuple]]:
        """Directories and path patterns: a text that describes each, and with ``[files:true]`` (repositories: unless
        ``[files:false]``) their files too. Places are spread out so that files follow their directory."""
        described, plain = [], []
        for r in rows:
            at, c = r["ord"] << 20, r["commands"]
            folder, pattern = directories.is_directory(r["path"]), bool(re.search(r"[*?\[\]]", r["path"])) and not re.match("https?://", r["path"])
            if not folder and not pattern:
                plain.append((at, r["attachy"], r["path"], c))
                continue
            git = folder and directories.is_repository(r["path"])
            most = int(c.get("max_files", 1000))
            if folder:
                listed = directories.listing(self.spark, r["path"], c.get("ignore", "standard"), c.get("glob", ""), c.get("recursive", "true") == "true", most, True)
                guard = directories.size_guard(listed).first()
                text = guard["text"] if guard["too_large"] and c.get("force", "false") != "true" else directories.repository_text(listed, r["path"]) if git else directories.structure(listed, r["path"])
                wanted = c.get("files", "true" if git and c.get("mode") != "structure" else "false") == "true" and not (guard["too_large"] and c.get("force", "false") != "true")
                described.append((at, r["attachy"], r["path"], c, "git" if git else "dir", text))
                listed = directories.listing(self.spark, r["path"], c.get("ignore", "standard"), c.get("glob", ""), c.get("recursive", "true") == "true", most)
            else:
                listed, wanted = directories.glob_listing(self.spark, r["path"], most), True
            if wanted:
                split = {k: c[k] for k in ("split", "characters", "tokens", "lines", "custom") if k in c}
                names = [x["path"] for x in listed.select("path", "rel").orderBy("rel").collect()]
                plain += [(at + 1 + k, n, re.sub("^file:(//)?", "", n), split) for k, n in enumerate(names)]
        return described, plain

    def _order(self) -> list[str]:
        return ["ord", "chunk_index"]

    def _one(self, df: DataFrame) -> str:
        row = df.first()
        return (row["text"] if row else "") or ""

    @property
    def text(self) -> str:
        body = self._one(fold.rendered(self.df.withColumn("_all", F.lit(1)), ["_all"], self._order())) if self.references else ""
        if self.prompt is None:
            return body
        return f"{self.prompt.strip()}\n\n{body}" if self.references else self.prompt

    def __str__(self) -> str:
        return self.text

    @property
    def images(self) -> list[str]:
        return [i for r in self.df.orderBy(*self._order()).select("images").toLocalIterator() for i in r["images"] if not i.endswith("_placeholder")] if self.references else []

    @property
    def metadata(self) -> dict:
        if not self.references:
            return {"prompt_only": True, "original_prompt": self.prompt}
        real = F.size(F.filter("images", lambda i: ~i.endswith("_placeholder")))
        rows = self.df.orderBy(*self._order()).select("path", F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), real.alias("image_count"), "metadata")
        files = [{**r.asDict(), "metadata": dict(r["metadata"] or {})} for r in rows.toLocalIterator()]
        return {"file_count": len(files), "image_count": sum(f["image_count"] for f in files), "files": files}

    def __len__(self) -> int:
        return self.df.count() if self.references else 0

    def __iter__(self):
        return iter(self.df.orderBy(*self._order()).toLocalIterator()) if self.references else iter(())

    def __getitem__(self, i: int):
        at = i if i >= 0 else len(self) + i
        rows = self.df.orderBy(*self._order()).offset(at).limit(1).collect() if at >= 0 else []
        if not rows:
            raise IndexError(i)
        return rows[0]

    def __getattr__(self, name: str):
        if name not in adapt.ADAPTERS:
            raise AttributeError(name)

        def message(*args, **kwargs) -> str:
            one = self.spark.createDataFrame([(self.text, self.images)], "text string, images array<string>")
            return adapt.ADAPTERS[name](one, *args, **kwargs).first()["message"]

        return message


def process(spark: SparkSession, *paths: str) -> Context:
    return Context(spark, *paths)


simple = process


def referenced(prompt: str) -> list[str]:
    """What a prompt names, each once, in the order of the patterns."""
    return list(dict.fromkeys(m for p in REFERENCES for m in re.findall(p, prompt)))


def auto_attach(spark: SparkSession, prompt: str, root_dir: str | list[str] | None = None) -> Context:
    roots = [os.getcwd()] if root_dir is None else [root_dir] if isinstance(root_dir, str) else list(root_dir)
    found = []
    for ref in referenced(prompt):
        if re.match("https?://", ref):
            found.append(ref)
            continue
        for root in roots:
            at = os.path.join(root, ref)
            if not re.match("https?://", root) and os.path.exists(at.split("[")[0]):
                found.append(ref if os.path.isabs(ref) else at)
                break
    return Context(spark, *found, prompt=prompt)


def references_in(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``references``: what each row's text names, distinct, by expressions alone."""
    hits = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in REFERENCES])
    return df.withColumn("references", F.array_distinct(hits))


def dsl_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(dsl.COMMANDS.items()), "command string, default string")
