"""User patterns as LIKE and Java regular expressions. Pure Python."""

from __future__ import annotations

import re

#: POSIX classes and what Java calls them; with (?U) they cover all scripts.
CLASSES = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "space": r"\s", "blank": r" \t", "punct": r"\p{IsPunctuation}", "cntrl": r"\p{Cntrl}", "xdigit": r"0-9A-Fa-f", "print": r"\P{Cntrl}", "graph": r"\P{IsWhite_Space}"}


def like_escape(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def glob_to_like(glob: str) -> str:
    """``*``: any run, ``?``: one character; whole-string match. Runs of stars are one."""
    return re.sub(r"%+", "%", "".join({"*": "%", "?": "_"}.get(c, like_escape(c)) for c in re.sub(r"\*+", "*", glob)))


def tags_to_like(tags: str) -> str | None:
    """Comma list -> pattern: every tag as a substring, in code-point order, without overlap. None if the list is empty."""
    wanted = sorted(t for t in tags.split(",") if t)
    return glob_to_like("*" + "*".join(wanted) + "*") if wanted else None


def glob_matches(glob: str, text: str) -> bool:
    """The same semantics in Python, for tests and small inputs."""
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return re.fullmatch(body, text, re.DOTALL) is not None


def anchored(pattern: str) -> str:
    """``^`` before and ``$`` behind, where they aren't there as characters; so ``a|b`` is ``^a|b$``."""
    return ("" if pattern.startswith("^") else "^") + pattern + ("" if pattern.endswith("$") else "$")


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """A POSIX extended expression for Spark's rlike; ValueError if it can't be one."""
    body = re.sub(r"\[:(\w+):\]", lambda m: CLASSES.get(m[1], m[0]), pattern)
    if re.search(r"\[:\w+:\]", body):
        raise ValueError(f"unknown character class in {pattern!r}")
    check_balance(body)
    return ("(?iuU)" if ignore_case else "(?U)") + body


def check_balance(pattern: str) -> None:
    """Reject what no engine takes, on the driver: open brackets and groups, a trailing backslash, a leading repeat."""
    depth, at, in_class = 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if at + 1 == len(pattern):
                raise ValueError(f"bad regular expression: {pattern!r}")
            at += 1
        elif in_class:
            in_class = c != "]" or pattern[at - 1] == "["
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise ValueError(f"bad regular expression: {pattern!r}")
        elif c in "*+?" and (at == 0 or pattern[at - 1] in "(|^"):
            raise ValueError(f"bad regular expression: {pattern!r}")
        at += 1
    if depth or in_class:
        raise ValueError(f"bad regular expression: {pattern!r}")
