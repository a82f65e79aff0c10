"""Texts that every match of a pattern holds."""

from __future__ import annotations

import string

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: other letters lower to these, so a text that ignores case by ``lower`` may hold them unseen
LOWERED_INTO = "ik"


def required_texts(pattern: str) -> list[str]:
    """Runs of plain characters outside groups and classes that each match of a (Java) pattern must hold.

    The rule gives up, with no text, where it would have to understand more: alternatives, inline flags, quotes, escapes with arguments,
    nested classes. What it returns is always required; it need not be all that is.
    """
    runs, run, i, n = [], "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        nxt = pattern[i + 1] if i + 1 < n else ""
        if c == "|" or c == ")":
            return []
        if c in "(":
            end = _group_end(pattern, i)
            if end is None:
                return []
            runs, run, i = [*runs, run], "", end
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return []
            runs, run, i = [*runs, run], "", end
        elif c in "*?{":
            runs, run = [*runs, run[:-1]], ""
            if c == "{":
                end = pattern.find("}", i)
                if end < 0:
                    return []
                i = end
            i += 1
        elif c in "+^$.":
            runs, run, i = [*runs, run], "", i + 1
        elif c == "\\":
            if not nxt or nxt in "QExupPkcN0":
                return []
            if nxt.isalnum():
                runs, run, i = [*runs, run], "", i + 2
                while nxt.isdigit() and i < n and pattern[i].isdigit():
                    i += 1
            else:
                run, i = run + nxt, i + 2
        else:
            run, i = run + c, i + 1
    return [r for r in [*runs, run] if r]


def _class_end(pattern: str, start: int) -> int | None:
    """The place after a character class without others inside; null where it is not that plain."""
    i = start + (2 if pattern[start + 1 : start + 2] == "^" else 1)
    if pattern[i : i + 1] in ("]", ""):
        return None
    while i < len(pattern):
        if pattern[i] == "]":
            return i + 1
        if pattern[i] == "[" or pattern[i : i + 2] == "\\Q":
            return None
        i += 2 if pattern[i] == "\\" else 1
    return None


def _group_end(pattern: str, start: int) -> int | None:
    """The place after a group; null for one that sets flags for what follows or is not closed."""
    i, depth = start, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] == "Q":
                return None
            i += 2
            continue
        if c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            i = end
            continue
        if c == "(":
            if pattern[i + 1 : i + 2] == "?" and pattern[i + 2 : i + 3] not in (":", "=", "!", "<", ">"):
                return None
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return None


def literal_texts(text: str, ignore_case: bool) -> list[str]:
    """The same for a literal; where case is ignored by ``lower``, only characters that nothing else lowers to."""
    if not ignore_case:
        return [text] if text else []
    kept = "".join(c if c.isascii() and c not in LOWERED_INTO else "\0" for c in text.lower())
    return [r for r in kept.split("\0") if r]
