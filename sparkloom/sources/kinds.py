"""What kind of file a path is, by its extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import extension

# The extensions taken, by kind; for code, by language.
KINDS = {"markdown": ["md", "markdown"], "pdf": ["pdf"], "docx": ["docx"], "text": ["txt", "text"]}
LANGUAGES = {
    "rust": ["rs"], "python": ["py"], "javascript": ["js", "mjs", "cjs"], "typescript": ["ts", "tsx"], "go": ["go"], "java": ["java"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp"], "ruby": ["rb"],
    "swift": ["swift"], "kotlin": ["kt", "kts"], "toml": ["toml"], "yaml": ["yaml", "yml"], "json": ["json"], "shell": ["sh", "bash", "zsh"],
}
BY_EXTENSION = {e: (kind, None) for kind, es in KINDS.items() for e in es} | {e: ("code", lang) for lang, es in LANGUAGES.items() for e in es}


def detect_kind(path: str) -> tuple[str, str | None]:
    """(kind, language); the kind is ``unknown`` for other extensions."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return BY_EXTENSION.get(ext.lower(), ("unknown", None)) if dot and stem else ("unknown", None)


def kind(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((e, k) for e, (k, _) in BY_EXTENSION.items())])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((e, lang) for e, (_, lang) in BY_EXTENSION.items() if lang)])
    return F.try_element_at(table, extension(path))
