"""Results as plain text, JSON or tab-separated lines, from a bounded page of rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame


def plain(results: DataFrame) -> Iterator[str]:
    for i, r in enumerate(results.toLocalIterator(), 1):
        yield f"[{i}] {r['path']} (score: {r['score']:.3f}, type: {r['type'] or 'doc'})"
        if r["content"] is not None:
            yield r["content"]
        elif r["snippet"]:
            yield f"    {r['snippet'].splitlines()[0]}"


def as_json(results: DataFrame) -> Iterator[str]:
    rows = [{c: round(r[c], 6) if c == "score" else r[c] for c in ("path", "score", "type", "snippet", "content")} for r in results.toLocalIterator()]
    yield json.dumps(rows, ensure_ascii=False, indent=2)


def tsv(results: DataFrame) -> Iterator[str]:
    clean = lambda s: (s or "").replace("\t", " ").replace("\n", " ").replace("\r", " ")
    for r in results.toLocalIterator():
        yield f"{r['path']}\t{r['score']:.6f}\t{clean(r['snippet'])}"


FORMATS = {"plain": plain, "json": as_json, "tsv": tsv}


def render(results: DataFrame, form: str = "plain") -> str:
    return "\n".join(FORMATS[form](results))


def write_tsv(results: DataFrame, path: str) -> None:
    results.select("path", "score", "snippet").write.mode("overwrite").option("sep", "\t").csv(path)


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
