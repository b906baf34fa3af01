"""Ignore files: a matcher for the usual pattern language (anchors, ``*``, ``?``, ``**``, ``[...]``, directories, negation)."""

from __future__ import annotations

import os
import re

NAMES = (".gitignore", ".ignore", ".searchignore")  # later ones win


def to_regex(pattern: str) -> re.Pattern:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out + r"\Z")


class Rules:
    """The patterns of one folder's ignore files."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((negated, only_dirs, to_regex(line.lstrip("/") if anchored else "**/" + line)))

    @classmethod
    def of(cls, folder: str) -> Rules:
        lines: list[str] = []
        for name in NAMES:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    lines += f.read().splitlines()
        return cls(folder, lines)

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: taken back, None: no pattern matches. The last one counts."""
        relative = os.path.relpath(path, self.folder).replace(os.sep, "/")
        for negated, only_dirs, regex in reversed(self.rules):
            if (is_dir or not only_dirs) and regex.match(relative):
                return not negated
        return None


def ignored(path: str, is_dir: bool, chain: list[Rules]) -> bool:
    for rules in reversed(chain):
        if (found := rules.verdict(path, is_dir)) is not None:
            return found
    return False
