"""Path globs as Java regexes, so that matching stays inside Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """Shell glob to a whole-string regex. `*` and `?` cross `/`, case matters."""
    out = []
    i = 0
    while i < len(glob):
        char = glob[i]
        i += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            # "]" straight after the bracket (or its "!") is a member, not the end.
            body = re.match(r"(!?)(\]?[^\]]*)\]", glob[i:])
            if body is None:
                out.append(r"\[")
                continue
            i += body.end()
            members = re.sub(r"([\\\[\]&~^|])", r"\\\1", body.group(2))
            out.append(f"[{'^' if body.group(1) else ''}{members}]")
        else:
            out.append(re.sub(r"(\W)", r"\\\1", char))
    collapsed = re.sub(r"(\.\*)+", ".*", "".join(out))
    return rf"(?s)\A{collapsed}\z"


def path_glob_regex(glob: str) -> str:
    """Glob over files to a whole-path regex: `*` and `?` stop at `/`, a `**` part crosses any
    number of folders, and a name that starts with a dot needs a dot in the glob."""
    parts = []
    names = glob.replace("\\", "/").split("/")
    for i, name in enumerate(names):
        last = i == len(names) - 1
        if name == "**":
            parts.append("(?:(?!\\.)[^/]+/)*" + ("(?!\\.)[^/]+" if last else ""))
            continue
        inner = glob_regex(name)[len(r"(?s)\A") : -len(r"\z")]
        # Outside a class, what crosses `/` for an exclusion does not here.
        inner = re.sub(r"(\\.)|(\[(?:\\.|[^\]])*\])|\.", lambda m: m[0] if m[1] or m[2] else "[^/]", inner)
        hidden = "" if not name or name.startswith(".") else "(?!\\.)"
        parts.append(hidden + inner + ("" if last else "/"))
    return rf"(?s)\A{''.join(parts)}\z"


def matches_path(path: Column, globs: tuple[str, ...]) -> Column:
    """True where the normalised path is one that at least one file glob names."""
    path, hit = normalise_path(path), F.lit(False)
    for glob in globs:
        hit = hit | path.rlike(path_glob_regex(glob))
    return hit


def normalise_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    """True where the normalised path matches at least one glob."""
    if not globs:
        return F.lit(False)
    path = normalise_path(path)
    hit = path.rlike(glob_regex(globs[0]))
    for glob in globs[1:]:
        hit = hit | path.rlike(glob_regex(glob))
    return hit


def glob_root(glob: str) -> str:
    """The fixed part before the first star."""
    return glob.replace("\\", "/").split("*")[0]
