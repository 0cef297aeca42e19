"""Globs to anchored regular expressions, compiled on the driver, that Java and RE2 read alike."""

from __future__ import annotations

_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_/-# ")


def glob_regex(glob: str, *, star_crosses: bool = True) -> str:
    """``**/`` is any folders or none, ``*`` any run of characters (with ``star_crosses`` also ``/``), ``?`` one, ``{a,b}`` either."""
    star = ".*" if star_crosses else "[^/]*"
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(star)
        elif c == "?":
            out.append("." if star_crosses else "[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out.append("[" + glob[i + 1 : end].replace("!", "^", 1) + "]")
            i = end
        else:
            out.append(c if c in _PLAIN else "\\" + c)
        i += 1
    return "^" + "".join(out) + "$"


def any_glob(globs: list[str], *, star_crosses: bool = True) -> str:
    """One expression for a list of globs; an empty list matches nothing."""
    return "|".join(glob_regex(g, star_crosses=star_crosses) for g in globs) or "a^"


def owner_glob(pattern: str) -> str:
    """A code owners' pattern: without a star it is a prefix; a leading slash doesn't count."""
    body = pattern.lstrip("/")
    return glob_regex(body if "*" in body else body + "**")
