"""Directories of source files: listing, ignore rules, one bundle of all."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and patterns that results depend on.
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "Gemfile.lock", "go.sum", "Cargo.lock", "composer.lock", "bun.lock", "bun.lockb")
#: Globs over whole relative paths, used where there is no ignore file.
FALLBACK = ("node_modules/**", ".git/**", "dist/**", "build/**", ".cache/**", ".next/**", "coverage/**", "*.log", ".env*", ".DS_Store", ".idea/**", ".vscode/**")
#: The bundle's lines.
PREAMBLE = ("# COMBINED CODEBASE CONTEXT", "# Generated on: {time}", "# Target: {target}", "# Files included: {n}", "# Note: Files are filtered using .gitignore patterns and lockfiles are excluded", "", "=" * 80, "")
HEADER, RULE, FOOTER = "# FILE PATH: ", "#" * 80, "# END OF FILE: "
_ROOT_MARKS = frozenset((*LOCKFILES, ".git"))


def find_project_root(start: str) -> str:
    """The first directory from start upwards that holds a lockfile or .git; start itself if none does."""
    here = Path(start).resolve()
    for d in (here, *here.parents):
        if any((d / m).exists() for m in _ROOT_MARKS):
            return str(d)
    return str(here)


def resolve_file(name: str, folder: str = ".corpus", start: str = ".", levels: int = 10) -> str:
    """The path of name below a ``folder`` of start or of one of its ancestors, up to so many levels."""
    here = Path(start).resolve()
    for d in (here, *here.parents)[: levels + 1]:
        if (d / folder / name).exists():
            return str(d / folder / name)
    raise FileNotFoundError(name)


def glob_regex(glob: str) -> str:
    """The regular expression of a glob over a whole path.

    A segment ** stands for any number of directories, * and ? for characters of one segment, [..] for one of some, {a,b}
    for either. A name that is nothing but * is not empty. A path may end in a slash (a directory).
    """
    return f"^(?:{'|'.join(map(_segments_regex, _braces(glob)))})/?$"


def _braces(glob: str) -> list[str]:
    """The glob without {a,b}: one for each choice."""
    m = re.search(r"\{([^{}]*,[^{}]*)\}", glob)
    return [glob] if m is None else [x for part in m[1].split(",") for x in _braces(glob[: m.start()] + part + glob[m.end() :])]


def _segments_regex(glob: str) -> str:
    out, parts = "", glob.split("/")
    for i, part in enumerate(parts):
        final = i == len(parts) - 1
        if part == "**":
            out += ".*" if final else "(?:[^/]+/)*"
        else:
            out += _name_regex(part) + ("" if final else "/")
    return out


def _name_regex(name: str) -> str:
    if name and not name.strip("*"):
        return "[^/]+"
    out, i = "", 0
    while i < len(name):
        end = name.find("]", i + 2)
        if name[i] == "*":
            out += "" if name[i - 1 : i] == "*" else "[^/]*"
        elif name[i] == "?":
            out += "[^/]"
        elif name[i] == "[" and end > 0:
            body = name[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        else:
            out += re.escape(name[i])
        i += 1
    return out


def ignore_glob(pattern: str) -> str:
    """The glob that a line of an ignore file stands for.

    A name without any slash is looked for at every depth; a slash anywhere, also at the end, binds the pattern to the
    root; with one at the end it takes all below.
    """
    glob = pattern if "/" in pattern else f"**/{pattern}"
    return (glob + "**" if glob.endswith("/") else glob).removeprefix("/")


def parse_ignore(text: str) -> tuple[list[str], list[str]]:
    """(ignore, keep) patterns of an ignore file; comments and empty lines left out."""
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    return [x for x in lines if not x.startswith("!")], [x[1:] for x in lines if x.startswith("!")]


def ignore_text(start: str) -> str | None:
    """The .gitignore files of start and of all directories above it but the file system's root, the topmost first; None if there are none."""
    here = Path(start).resolve()
    found = [d / ".gitignore" for d in (here, *here.parents) if d != d.parent and (d / ".gitignore").is_file()]
    return "\n".join(f.read_text(encoding="utf-8", errors="replace") for f in reversed(found)) if found else None


def matches(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of some globs."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def ignored(path: Column, ignore: list[str], keep: list[str] = ()) -> Column:
    """Whether a relative path matches a pattern of an ignore file and none that keeps it."""
    return matches(path, [ignore_glob(p) for p in ignore]) & ~matches(path, [ignore_glob(p) for p in keep])


def walked(path: Column) -> Column:
    """The relative path and the directories on the way to it, each with a slash at its end: what a walk of the tree meets."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    return F.concat(F.coalesce(above, F.array().cast("array<string>")), F.array(path))


def excluded(path: Column, ignore: str | None = None) -> Column:
    """Whether a walk leaves a relative path out: lockfiles, and what the ignore file's text (or FALLBACK) says.

    A directory that is left out takes all below with it, whatever a later pattern would keep.
    """
    if ignore is None:
        out = lambda p: matches(p, list(FALLBACK))
    else:
        drop, keep = parse_ignore(ignore)
        out = lambda p: ignored(p, drop, keep)
    return F.exists(walked(path), lambda p: is_lockfile(F.rtrim(p, F.lit("/"))) | out(p))


def is_lockfile(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*LOCKFILES)


def list_files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """(path, content, length): all files below root, path relative to it; hidden ones only if asked for."""
    base = Path(root).resolve().as_uri() if "://" not in root else root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    short = re.sub(r"^file:/+", "/", base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(short) + "/", "")
    rows = rows.select(rel.alias("path"), "content", "length")
    return rows if hidden else rows.where(~F.col("path").rlike(r"(^|/)\."))


def select_files(files: DataFrame, ignore: str | None = None) -> DataFrame:
    """files less what excluded() says of their paths."""
    return files.where(~excluded(F.col("path"), ignore))


def bundle(files: DataFrame, text_col: str = "content") -> DataFrame:
    """(path, body): each file between a header and a footer, sorted by path; files that are no UTF-8 text are left out.

    Writing it with one partition gives the bundle; the sort is distributed.
    """
    raw = F.col(text_col)
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")) if dict(files.dtypes)[text_col] == "binary" else raw
    rows = files.select("path", text.alias("body")).where("path is not null and body is not null")
    body = F.concat(F.lit(f"\n{RULE}\n{HEADER}"), "path", F.lit(f"\n{RULE}\n\n"), "body", F.lit(f"\n{FOOTER}"), "path", F.lit("\n\n"))
    return rows.select("path", body.alias("body")).orderBy("path")


def preamble(target: str, n: int, time: str | None = None) -> str:
    """The lines before the first file."""
    stamp = time or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return "".join(line.format(time=stamp, target=target, n=n) + "\n" for line in PREAMBLE)


def write_bundle(files: DataFrame, path: str, overwrite: bool = True, target: str = ".", time: str | None = None) -> int:
    """Write preamble() and bundle() as one text file of a folder; returns how many files were included (text or not)."""
    n = files.count()
    head = files.sparkSession.createDataFrame([(0, "", preamble(target, n, time))], "k int, path string, body string")
    rows = head.union(bundle(files).select(F.lit(1), "path", "body")).coalesce(1).sortWithinPartitions("k", "path")
    # The text sink ends each row with a newline: the last one of a body.
    rows.select(F.regexp_replace("body", r"\n\z", "")).write.mode("overwrite" if overwrite else "errorifexists").text(path)
    return n
