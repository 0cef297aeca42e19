"""Members of exported classes, enums and namespaces, accesses to members of imported names, and uses of a file's own exports.

Like ``extract``, a documented subset without a parser: braces are matched on text whose comments and strings are blank. Scopes are not known, so
an inner variable that is called like an export counts as a use of it. A member whose declaration starts in the middle of a line after another's is found
only behind ``;`` or ``}``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.sources.extract import facts, script_of, stripped

FACT = "kind string, parent string, member string, member_kind string, is_public boolean, line int"
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_HELD = re.compile(r"\$\{[^{}`]*\}")
_OWNER = re.compile(r"^[ \t]*export\s+(?:declare\s+)?(?:default\s+)?(?:abstract\s+)?(?:const\s+)?(class|enum|namespace)\s+([\w$]+)[^{;]*\{", re.M)
_CLASS_MEMBER = re.compile(r"(?:^|[;}\n])[ \t]*((?:(?:public|protected|private|static|readonly|abstract|override|async|declare|accessor|get|set)[ \t]+)*)\*?[ \t]*([A-Za-z_$][\w$]*)[ \t]*[?!]?[ \t]*(?=([(<])|[=:;\n}]|$)")
_VARIANT = re.compile(r"\s*(?:([A-Za-z_$][\w$]*)|['\"]([^'\"\n]*)['\"])")
_INNER = re.compile(r"\bexport\s+(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const\s+enum|enum|interface|type|namespace|const|let|var)\s+([\w$]+)")
_NEW = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;\n]+)?=\s*new\s+([\w$]+)")
_ACCESS = re.compile(r"(?<![\w$])([\w$]+)\.(?=([\w$]+)[ \t]*(=(?!=))?)")
_COLON, _BEFORE_KEY = re.compile(r"\s*:(?!:)"), re.compile(r"[{,]\s*$")
_DECLARES = re.compile(r"\b(?:function\*?|class|enum|interface|type|namespace|const|let|var)\s+$")


def blanked(code: str) -> str:
    """Code of the same length whose strings are spaces; what templates hold in ``${}`` stays."""

    def blank(m: re.Match) -> str:
        held = _HELD.finditer(m.group()) if m.group()[0] == "`" else ()
        out = list(re.sub(r"[^\n]", " ", m.group()))
        for h in held:
            out[h.start() : h.end()] = h.group()
        return "".join(out)

    return _STRING.sub(blank, code)


def closing(code: str, start: int) -> int:
    """Where the brace closes whose body starts at ``start``; the end for one that stays open."""
    depth = 1
    for m in re.finditer(r"[{}]", code[start:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return start + m.start()
    return len(code)


def outermost(body: str) -> str:
    """A body with what stands inside any brackets as spaces, line breaks included."""
    out, depth = [], 0
    for part in re.split(r"([{}()\[\]])", body):
        if part and part in "})]":
            depth = max(0, depth - 1)
        out.append(part if not depth else " " * len(part))
        if part and part in "{([":
            depth += 1
    return "".join(out)


def _owned(kind: str, code: str, plain: str, start: int) -> Iterator[tuple[str, str, int]]:
    """(member, its kind, offset) of the body that starts at ``start``."""
    end = closing(plain, start)
    shell = outermost(plain[start:end])
    if kind == "class":
        for m in _CLASS_MEMBER.finditer(shell):
            words, name, method = m.group(1).split(), m.group(2), m.group(3)
            if "private" in words and not method or name == "constructor":
                continue
            if "get" in words or "set" in words:
                found = "Getter" if "get" in words else "Setter"
            else:
                found = ("Static" if "static" in words else "") + ("Method" if method else "Property")
            yield name, found, start + m.start(2)
    elif kind == "enum":
        commas = [-1, *(m.start() for m in re.finditer(",", shell))]
        for at in commas:
            if m := _VARIANT.match(code, start + at + 1, end):
                yield m.group(1) or m.group(2), "EnumVariant", m.start(1) if m.group(1) else m.start(2)
    else:
        for m in _INNER.finditer(shell):
            yield m.group(1), "NamespaceMember", start + m.start(1)


def members(path: str, text: str) -> list[tuple]:
    """Rows of ``FACT`` of one file: kinds ``member`` (with what it is), ``read`` and ``write`` (parent is the imported name), ``use`` (member is the export)."""
    script, _ = script_of(path, text)
    code = stripped(script)
    plain = blanked(code)
    lines = script.split("\n")
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1

    def public(at: int) -> bool:
        k = at - 2
        if k < 0 or not lines[k].rstrip().endswith("*/"):
            return False
        first = k
        while first > 0 and "/*" not in lines[first]:
            first -= 1
        return "@public" in "\n".join(lines[first : k + 1])

    rows: list[tuple] = []
    for m in _OWNER.finditer(plain):
        for name, what, at in _owned(m.group(1), code, plain, m.end()):
            rows.append(("member", m.group(2), name, what, public(line(at)), line(at)))
    known = facts(path, text)
    imported = {f[3] for f in known if f[0] == "import" and f[3]}
    objects = {name: name for name in imported} | {m.group(1): m.group(2) for m in _NEW.finditer(plain) if m.group(2) in imported}
    for m in _ACCESS.finditer(plain):
        if m.group(1) in objects:
            rows.append(("write" if m.group(3) else "read", objects[m.group(1)], m.group(2), None, False, line(m.start())))
    exported = {f[2] for f in known if f[0] == "export"} - {"default"} - imported
    for m in re.finditer(r"(?<![\w$.])[A-Za-z_$][\w$]*", plain):
        if m.group() not in exported or _DECLARES.search(plain[max(0, m.start() - 40) : m.start()]):
            continue
        if _COLON.match(plain, m.end()) and _BEFORE_KEY.search(plain[max(0, m.start() - 200) : m.start()]):
            continue  # an object's key
        rows.append(("use", None, m.group(), None, False, line(m.start())))
    return rows


def member_facts(files: DataFrame) -> DataFrame:
    """Rows (rel_path, kind, parent, member, member_kind, is_public, line) of rows (rel_path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.int32()]
        for batch in batches:
            rows = [(path, *f) for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in members(path or "", text or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rel_path", "kind", "parent", "member", "member_kind", "is_public", "line"])

    return files.select("rel_path", "text").mapInArrow(run, f"rel_path string, {FACT}")
