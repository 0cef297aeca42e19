"""Facts of JavaScript and TypeScript sources, and of component files, in one vectorised pass per file.

This is a documented subset without a parser: comments are taken out by a scanner that knows strings, then statements are matched.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = "kind string, specifier string, name string, local string, is_type boolean, line int"
_NAMES = re.compile(r"\s*(type\s+)?([\w$*]+|default)(?:\s+as\s+([\w$]+))?\s*$")
_IMPORT = re.compile(r"^[ \t]*import\s+(type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s+as\s+([\w$]+)\s*|\{([^}]*)\}\s*)?from\s*['\"]([^'\"]+)['\"]", re.M)
_BARE = re.compile(r"^[ \t]*import\s*['\"]([^'\"]+)['\"]", re.M)
_EQUALS = re.compile(r"^[ \t]*import\s+([\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", re.M)
_STAR = re.compile(r"^[ \t]*export\s+(type\s+)?\*\s*(?:as\s+([\w$]+)\s*)?from\s*['\"]([^'\"]+)['\"]", re.M)
_FROM = re.compile(r"^[ \t]*export\s+(type\s+)?\{([^}]*)\}\s*(?:from\s*['\"]([^'\"]+)['\"])?", re.M)
_DECLARED = re.compile(r"^[ \t]*export\s+(?:declare\s+)?(default\s+)?(?:async\s+)?(?:abstract\s+)?(function\*?|class|const enum|enum|interface|type|namespace|const|let|var)\s+([\w$]+)", re.M)
_DEFAULT = re.compile(r"^[ \t]*export\s+default\b", re.M)
# Calls with a literal specifier, by the kind of edge that they make.
CALLS = [
    ("DynamicImport", re.compile(r"(?<![\w$.])import\(\s*['\"]([^'\"]+)['\"]")), ("RequireResolve", re.compile(r"(?<![\w$])require\.resolve\(\s*['\"]([^'\"]+)['\"]")),
    ("Require", re.compile(r"(?<![\w$.])require\(\s*['\"]([^'\"]+)['\"]")), ("ImportMetaResolve", re.compile(r"import\.meta\.resolve\(\s*['\"]([^'\"]+)['\"]")),
    ("UrlConstructor", re.compile(r"new\s+URL\(\s*['\"]([^'\"]+)['\"]\s*,\s*import\.meta\.url")),
]
_CONTEXT = re.compile(r"require\.context\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*(true|false)(?:\s*,\s*/((?:\\.|[^/\\\n])+)/)?)?")
_GLOB = re.compile(r"import\.meta\.glob\w*\(\s*(\[[^\]]*\]|['\"][^'\"]+['\"])")
_IN_COMMENTS = [("TripleSlashFile", re.compile(r"^///\s*<reference\s+path=['\"]([^'\"]+)", re.M)), ("TripleSlashTypes", re.compile(r"^///\s*<reference\s+types=['\"]([^'\"]+)", re.M)), ("JsDocImport", re.compile(r"\*[^\n]*?import\(['\"]([^'\"]+)['\"]\)"))]
_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script>", re.S)
_FRONT = re.compile(r"\A---\n(.*?)\n---", re.S)
_TAG = re.compile(r"<([A-Z][\w.]*|[a-z][a-z0-9]*-[\w-]+)")


def stripped(text: str) -> str:
    """The text with comments as spaces; line breaks, strings and templates stay."""
    out, i, n = [], 0, len(text)
    mark = re.compile(r"//|/\*|['\"`]")
    while (m := mark.search(text, i)) is not None:
        out.append(text[i : m.start()])
        j = m.start()
        if m.group() == "//":
            i = n if (e := text.find("\n", j)) < 0 else e
        elif m.group() == "/*":
            i = n if (e := text.find("*/", j + 2)) < 0 else e + 2
            out.append(re.sub(r"[^\n]", " ", text[j:i]))
        else:
            i = j + 1
            while i < n and text[i] != m.group() and (m.group() == "`" or text[i] != "\n"):
                i += 2 if text[i] == "\\" else 1
            i = min(n, i + 1)
            out.append(text[j:i])
    return "".join([*out, text[i:]])


def pascal(tag: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in tag.split("-"))


def script_of(path: str, text: str) -> tuple[str, str]:
    """The script of a file, on its own lines, and the template around it (empty for plain sources)."""
    if path.endswith((".vue", ".svelte")):
        blocks = list(_SCRIPT.finditer(text))
        template = _SCRIPT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        at = [text[: m.start(1)].count("\n") for m in blocks]
        script, done = "", 0
        for m, lines in zip(blocks, at, strict=True):
            script += "\n" * (lines - done) + m.group(1)
            done = lines + m.group(1).count("\n")
        return script, template
    if path.endswith(".astro"):
        m = _FRONT.match(text)
        return ("\n" + m.group(1), "\n" * text[: m.end()].count("\n") + text[m.end() :]) if m else ("", text)
    if path.endswith(".mdx"):
        return "\n".join(line if re.match(r"(import|export)\b", line) else "" for line in text.split("\n")), text
    return text, ""


def facts(path: str, text: str) -> list[tuple]:
    """Rows of ``FACT`` of one file, in order of kinds and places."""
    rows: list[tuple] = []
    text, template = script_of(path, text)
    code = stripped(text)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1

    def names(body: str) -> Iterator[tuple[str, str, bool]]:
        for part in body.split(","):
            if m := _NAMES.match(part):
                yield m.group(2), m.group(3) or m.group(2), bool(m.group(1))

    for m in _IMPORT.finditer(code):
        kind = bool(m.group(1))
        at = line(m.start())
        if m.group(2):
            rows.append(("import", m.group(5), "default", m.group(2), kind, at))
        if m.group(3):
            used = set(re.findall(rf"(?<![\w$.]){re.escape(m.group(3))}\.([\w$]+)", code))
            loose = re.search(rf"(?<![\w$.]){re.escape(m.group(3))}(?!\s*\.\s*[\w$])(?![\w$])", code[m.end() :])
            rows += [("import", m.group(5), x, m.group(3), kind, at) for x in (sorted(used) if used and not loose else ["*"])]
        rows += [("import", m.group(5), n, a, kind or t, at) for n, a, t in names(m.group(4) or "")]
    rows += [("side-effect", m.group(1), None, None, False, line(m.start())) for m in _BARE.finditer(code)]
    rows += [("ImportEquals", m.group(2), "*", m.group(1), False, line(m.start())) for m in _EQUALS.finditer(code)]
    rows += [("reexport", m.group(3), "*", m.group(2) or "*", bool(m.group(1)), line(m.start())) for m in _STAR.finditer(code)]
    for m in _FROM.finditer(code):
        for n, a, t in names(m.group(2)):
            rows.append(("reexport" if m.group(3) else "export", m.group(3), n if m.group(3) else a, a if m.group(3) else n, bool(m.group(1)) or t, line(m.start())))
    for m in _DECLARED.finditer(code):
        rows.append(("export", None, "default" if m.group(1) else m.group(3), m.group(3), m.group(2) in ("interface", "type"), line(m.start())))
    declared = {m.start() for m in _DECLARED.finditer(code)}
    rows += [("export", None, "default", None, False, line(m.start())) for m in _DEFAULT.finditer(code) if m.start() not in declared]
    for kind, pattern in CALLS:
        rows += [(kind, m.group(1), None, None, False, line(m.start())) for m in pattern.finditer(code)]
    # A folder's files: which of them (name, an expression over paths from the folder) and whether of its folders too (local).
    rows += [("RequireContext", m.group(1), m.group(3) and m.group(3).replace("\\/", "/"), m.group(2), False, line(m.start())) for m in _CONTEXT.finditer(code)]
    for m in _GLOB.finditer(code):
        rows += [("ImportMetaGlob", g, None, None, False, line(m.start())) for g in re.findall(r"['\"]([^'\"]+)['\"]", m.group(1))]
    for kind, pattern in _IN_COMMENTS:
        rows += [(kind, m.group(1), None, None, kind != "TripleSlashFile", text.count("\n", 0, m.start()) + 1) for m in pattern.finditer(text)]
    rows += [("component", None, pascal(t) if "-" in t else t.split(".")[0], t, False, template.count("\n", 0, m.start()) + 1) for m in _TAG.finditer(template) for t in [m.group(1)]]
    return rows


def extracted(files: DataFrame) -> DataFrame:
    """Rows (rel_path, kind, specifier, name, local, is_type, line) of rows (rel_path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.int32()]
        for batch in batches:
            rows = [(path, *f) for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in facts(path or "", text or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rel_path", "kind", "specifier", "name", "local", "is_type", "line"])

    return files.select("rel_path", "text").mapInArrow(run, f"rel_path string, {FACT}")
