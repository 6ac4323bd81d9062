"""One pattern notation for two engines.

Patterns are written with the meaning that ASCII ``\\b``, ``\\w``, ``\\d`` and a Unicode ``\\s`` have in
browsers. ``java`` gives the pattern for Spark, whose ``\\b`` would also treat accented letters as word
characters and whose ``\\s`` is ASCII; ``re2`` gives it for DuckDB.
"""

from __future__ import annotations

import re

#: The characters of \s.
SPACES = [(0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
#: One by one, as Java looks single characters up in a table and tries ranges one after another.
DIGIT, CAPITAL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = f"[{DIGIT}{CAPITAL}{CAPITAL.lower()}_]"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
NO_BOUNDARY = f"(?:(?<!{WORD})(?!{WORD})|(?<={WORD})(?={WORD}))"


def _not_space() -> str:
    """All characters but those of \\s, as a class whose parts are tried from the first on: printable ASCII ones are told by one look."""
    edges = [0, *(x for a, b in SPACES for x in (a, b + 1)), 0x110000]
    others = [(a, b - 1) for a, b in zip(edges[::2], edges[1::2])]
    return f"[!-~[{''.join(f'\\x{{{a:X}}}-\\x{{{b:X}}}' for a, b in others if a < b)}]]"


NOT_SPACE = _not_space()
#: What a class that is met at every character looks at first: few characters of a text are not printable ASCII ones. Without ``^``, as threads that share a JVM wait for each other where Java negates a class.
BEYOND = r"[\x{0}- \x{7F}-\x{FEFF}]"


def _space(escape: str) -> str:
    one = lambda c: escape % c
    return "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in SPACES)


JAVA_SPACE = _space(r"\x{%X}")
RUN = re.compile("[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]")


def _translate(pattern: str, space: str, boundary: str, no_boundary: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith(r"[\s\S]", i):  # any character at all
            out.append("(?s:.)")
            i += 6
            continue
        if c == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(space if inside else f"[{space}]" if boundary != BOUNDARY else f"[{BEYOND}&&[{space}]]")
            elif pair == r"\S":
                if inside:
                    raise ValueError(r"\S inside a class")
                out.append(f"[^{space}]" if boundary != BOUNDARY else NOT_SPACE)
            elif pair == r"\b" and not inside:
                out.append(boundary)
            elif pair == r"\B" and not inside:
                out.append(no_boundary)
            else:
                out.append(pair)
            i += 2
            continue
        if inside and boundary == BOUNDARY and (run := RUN.match(pattern, i)):  # one by one, as above
            out.append("".join(map(chr, range(ord(run[0][0]), ord(run[0][2]) + 1))))
            i += 3
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "." and not inside:
            c = r"[^\n\r]"
        out.append(c)
        i += 1
    return "".join(out)


#: A boundary in front of something that always begins with a word character, where half the test is enough.
BEFORE_WORD = re.compile(r"\\b(?=(?:\(\?:)*(?:[A-Za-z0-9]|\\d|\[(?:A-Z|0-9|1-9|CEHX|A-Fa-f|0-9A-Fa-f|a-fA-F0-9)\]))")


#: What such a pattern can begin with, where it is written as one class; and the choices in use that all begin with a digit.
FIRST = re.compile(r"\\b(?=(\\d|\[(?:A-Z|0-9|1-9|CEHX|A-Fa-f|0-9A-Fa-f|a-fA-F0-9)\]))")
FIRST_DIGIT = re.compile(r"\\b(?=\(\?:(?:\\d\[ -\]|\\d\{1,2\}\[-/\\s\]|0\?\[1-9\]|19\|20\)|\(\?:25\[0-5\]))")
#: A choice of plain words at a pattern's begin.
CHOICE = re.compile(r"^\(\?:((?:[A-Za-z][A-Za-z ]*\|)+[A-Za-z][A-Za-z ]*)\)")


def _one_by_one(kind: str) -> str:
    return f"[{DIGIT}]" if kind == r"\d" else kind.replace("A-Z", CAPITAL).replace("0-9", DIGIT).replace("1-9", DIGIT[1:]).replace("A-F", "ABCDEF").replace("a-f", "abcdef")


#: An address up to its @: of a run of such characters only the first can begin a match, or the one that the match before left.
BEFORE_AT = re.compile(r"^(\[[^\]]+\])(\+|\{2,\})@")


def java(pattern: str) -> str:
    """Most characters can begin no match, which a look at one class tells before anything else is tried."""
    pattern = BEFORE_AT.sub(r"(?:(?<!\1)|\\G)\1\2+@", pattern)
    words = CHOICE.match(pattern)
    begins = f"(?=[{''.join(sorted({w[0] for w in words[1].split('|')}))}])" if words else ""
    pattern = FIRST_DIGIT.sub(f"(?=[{DIGIT}])(?<!{WORD})", pattern)
    pattern = FIRST.sub(lambda m: f"(?={_one_by_one(m[1])})(?<!{WORD})", pattern)
    return begins + _translate(BEFORE_WORD.sub(f"(?<!{WORD})", pattern), JAVA_SPACE, BOUNDARY, NO_BOUNDARY)


#: Characters from the rarest in prose to the most frequent; all others are rarer.
FREQUENT = "jqxzkvwybpgfmhculdosritna e"


def core(word: str) -> str:
    """A word from its rarest character on, but most of a short word and four characters of others: what holds the word holds its core, and few places in a text can begin one."""
    return word[min(range(max(1, len(word) + 1 - max(2, min(4, len(word) - 1)))), key=lambda i: FREQUENT.find(word[i])) :]


def marks(words: list[str], any_case: bool = False) -> str:
    """A Java pattern whose group 1 is, wherever one of the words begins, the longest that begins there; a match takes no character, so that words may overlap.

    any_case: of words in lower case, their ASCII letters in either case, so that no text is lower-cased for it.
    """
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    cases = lambda c: [c, c.upper()] if any_case and "a" <= c <= "z" else [c]
    one = lambda c: f"[{''.join(cases(c))}]" if len(cases(c)) > 1 else re.escape(c) if not c.isalnum() else c

    def choice(of: dict) -> str:
        parts = [one(c) + below(of[c]) for c in sorted(of) if c]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    def below(of: dict) -> str:
        more = choice(of) if any(of) else ""
        return f"(?:{more})?" if more and "" in of else more

    # few alternatives are tried at a place: the class of its character picks them
    firsts, few = sorted(tree), 5
    groups = [firsts[i : i + few] for i in range(0, len(firsts), few)]
    kind = lambda cs: f"[{''.join(re.escape(x) for c in cs for x in cases(c))}]"
    return f"(?={kind(firsts)})(?=({'|'.join(f'(?={kind(g)}){choice({c: tree[c] for c in g})}' for g in groups)}))"


def re2(pattern: str) -> str:
    return _translate(pattern, _space(r"\x{%X}"), r"\b", r"\B")


def sql_string(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2_sql(pattern: str) -> str:
    if re.search(r"\(\?<|\(\?!|\(\?=", pattern):
        raise ValueError("RE2 has no lookaround")
    return sql_string(re2(pattern))
