"""Regex dialect helpers.

Rule patterns are written in the JavaScript dialect and matched
case-insensitively.  Spark evaluates them with java.util.regex, the DuckDB
oracle with RE2.  Java understands every rule pattern as written; RE2 has no
look-ahead, so the oracle gets boolean-equivalent rewrites that keep the match
start (the only position we report).
"""

from __future__ import annotations

# JavaScript's \s (String.prototype.trim strips the same set), spelled out so
# Java (ASCII \s) and RE2 (ASCII \s without \v) agree with it.
JS_SPACE_JAVA = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
JS_SPACE_RE2 = (r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")

# Look-ahead forms used by the rule catalogue → RE2 forms with the same set of
# match starts.  Listed explicitly; `to_re2` refuses anything it cannot map.
_RE2_REWRITES = [
    (r"(?:\.0|\.1)?(?!\.[2-9])", r"(?:[^.]|\.(?:[^2-9]|$)|$)"),
    (r"(?!\d)", r"(?:[^0-9]|$)"),
]


def java_ci(pattern: str) -> str:
    """Case-insensitive Java form of a rule pattern (ASCII folding, like JS /i)."""
    return "(?i)" + pattern


def union(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def to_re2(pattern: str) -> str:
    out = pattern
    for src, dst in _RE2_REWRITES:
        out = out.replace(src, dst)
    if "(?!" in out or "(?=" in out or "(?<" in out:
        raise ValueError(f"no RE2 form for pattern {pattern!r}")
    return out


def re2_ci(pattern: str) -> str:
    return "(?i)" + to_re2(pattern)


def js_word_boundary_java(pattern: str) -> str:
    """JS `\\b` is ASCII-only; Java 17's is Unicode-aware.  Trailing `\\b`
    after a word character becomes an ASCII look-ahead."""
    return pattern.replace(r"\b", r"(?![A-Za-z0-9_])")


def sql_str(s: str) -> str:
    """Single-quoted SQL literal (standard doubling; no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"


_META = set(".^$*+?()[]{}|\\")


def literal_of(pattern: str) -> str | None:
    """The literal text a pattern matches, if it is a plain literal (escaped
    punctuation allowed); None for any real regex construct."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if i + 1 < len(pattern) and not pattern[i + 1].isalnum():
                out.append(pattern[i + 1])
                i += 2
                continue
            return None
        if ch in _META:
            return None
        out.append(ch)
        i += 1
    return "".join(out)


def effective_patterns(patterns: list[str]) -> list[str]:
    """Drop a plain literal that holds an earlier plain literal (ASCII, case
    aside): wherever it matches, the earlier one does too, so it is never the
    first matching pattern (P5) and never changes the union (P4).  Patterns
    with any other construct are kept, whatever their dialect."""
    kept: list[str] = []
    seen: list[str] = []
    for p in patterns:
        lit = literal_of(p)
        plain = lit.lower() if lit and lit.isascii() else None
        if plain and any(x in plain for x in seen):
            continue
        kept.append(p)
        if plain:
            seen.append(plain)
    return kept
