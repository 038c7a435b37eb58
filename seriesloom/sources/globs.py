"""Which names a pattern selects."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.parser import TAG_QUERY, tag_terms


def glob_regex(pattern: str) -> str:
    """A pattern as a regular expression: * within a node, ? one character, [..] a set, {a,b} a choice."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "*":
            out += "[^.]*"
        elif c == "?":
            out += "[^.]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = end
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return out


def literal_prefix(pattern: str) -> str:
    """What every match begins with, for skipping row groups of files sorted by name."""
    m = re.match(r"[^*?\[{\\]*", pattern)
    return m.group() if m else ""


def matches(pattern: str, name: Column, path: Column, tags: Column) -> Column:
    """Whether a series is selected by a glob over its path, a full name, or a tag query."""
    if pattern.startswith(TAG_QUERY + "("):
        out = F.lit(True)
        for key, op, value in tag_terms(pattern):
            got = path if key in ("name", "__name__") else F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))
            hit = got == value if op in ("=", "!=") else got.rlike(f"^(?:{value})")
            out = out & (hit if op in ("=", "=~") else ~hit)
        return out
    if re.search(r"[*?\[{\\]", pattern):
        hit = path.rlike(f"^{glob_regex(pattern)}$")
        prefix = literal_prefix(pattern)
        return (path.startswith(prefix) & hit) if prefix else hit
    return (path == pattern) | (name == pattern)


def match_order(pattern: str, name: Column) -> list[Column]:
    """What puts the matches of a pattern in order: node by node from the left, of those that are globs.

    A node with braces goes by the alternative it matches first, in the order
    they are written, and then by its text.
    """
    out: list[Column] = []
    if pattern.startswith(TAG_QUERY + "("):
        return [name]
    nodes = F.split(F.split(name, ";")[0], r"\.")
    for i, part in enumerate(pattern.split(".")):
        if not re.search(r"[*?\[{]", part):
            continue
        node = F.coalesce(F.get(nodes, F.lit(i)), F.lit(""))
        a, b = part.find("{"), part.find("}")
        if 0 <= a < b:
            ways = part[a + 1 : b].split(",")
            place = F.lit(len(ways))
            for k in reversed(range(len(ways))):
                place = F.when(node.rlike(f"^{glob_regex(part[:a] + ways[k] + part[b + 1:])}$"), k).otherwise(place)
            out.append(place)
        out.append(node)
    return [*out, name]
