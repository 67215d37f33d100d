"""Code structure by one small lexer: comments and strings are blanked, braces are matched, and a table of rules for each language tells items, imports and calls."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
QUOTED = r'"(?:\\[\s\S]|[^"\\])*"'
SINGLE = r"'(?:\\[\s\S]|[^'\\\n])*'"
TICKED = r"`(?:\\[\s\S]|[^`\\])*`"
NAME = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Rules:
    """skip: comments and strings; modifiers and heads of items at the start of a line; kinds by keyword; imports on the text itself."""

    skip: str
    heads: str
    kinds: dict[str, str]
    imports: str
    words: frozenset[str]
    #: A line's end closes an item that has opened nothing.
    lines_end: bool = False
    #: Classes hold methods, which are heads of their own there.
    methods: str | None = None
    bases: tuple[tuple[str, str], ...] = ()


# fixed values: words that may stand before a parenthesis and call nothing
RUST = frozenset("if for while loop match return else in fn let move impl where as unsafe pub crate use mut ref dyn async await yield".split())
SCRIPT = frozenset("if for while switch return catch else do in of function class new super import export async await yield typeof instanceof void delete throw case constructor".split())
GO = frozenset("if for switch return else go defer select range chan map interface struct type var const import func case fallthrough".split())
PHP = frozenset("if for while switch match return catch else do elseif foreach function fn class new array list isset unset empty echo print exit die include include_once require require_once declare static use and or xor clone yield throw parent self".split())

_TS = Rules(
    f"{COMMENT}|{QUOTED}|{SINGLE}|{TICKED}",
    rf"^[ \t]*(?P<mods>(?:(?:export|default|async|abstract|declare)\s+)*)(?:(?P<word>function|class|interface|enum|type|namespace)\b\s*\*?\s*(?P<name>{NAME})?|(?P<other>(?<=export\s)(?:const|let|var)\b\s*(?P<const>{NAME})?|(?<=export\s)(?=[{{*])|(?<=default\s)(?=\S)))",
    {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "interface", "namespace": "module"},
    r"^[ \t]*import\b[^;'\"`]*?(?:from\s*)?(['\"])(?P<what>[^'\"\n]+)\1",
    SCRIPT, True, rf"(?:^|(?<=[{{;}}]))[ \t]*(?:(?:public|private|protected|static|readonly|async|get|set|abstract|override)\s+)*\*?(?P<name>#?{NAME})\s*(?:<[^>\n]*>)?\(",
    (("extends", rf"\bextends\s+({NAME}(?:\.{NAME})*)"), ("implements", r"\bimplements\s+([^{]+)")),
)
LANGUAGES = {
    "rust": Rules(
        rf"{COMMENT}|\br(?P<hashes>#*)\"[\s\S]*?\"(?P=hashes)|{QUOTED}|'(?:\\[^'\n]+|[^'\\\n])'",
        rf"^[ \t]*(?P<mods>(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|default|extern)\s+)*)(?P<word>fn|struct|enum|trait|impl|mod|type)\b\s*(?:<[^{{;]*?>\s*)?(?P<name>{NAME})?",
        {"fn": "function", "struct": "class", "enum": "class", "trait": "interface", "impl": "class", "mod": "module", "type": "interface"},
        r"^[ \t]*(?:pub\s+)?use\s+(?P<what>[^;]+);",
        RUST,
    ),
    "typescript": _TS,
    "javascript": _TS,
    "go": Rules(
        f"{COMMENT}|{QUOTED}|{SINGLE}|`[^`]*`",
        rf"^[ \t]*(?P<mods>)(?P<word>func|type)\b\s*(?:\([^)]*\)\s*)?(?P<name>{NAME})?",
        {"func": "function", "type": "interface"},
        r"^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<what>[^\"\n]+)\"[ \t]*$",
        GO, True,
    ),
    "php": Rules(
        rf"{COMMENT}|#(?!\[)[^\n]*|{QUOTED}|{SINGLE}",
        rf"^[ \t]*(?P<mods>(?:(?:abstract|final|readonly)\s+)*)(?P<word>function|class|interface|trait|enum|namespace)\b\s*&?\s*(?P<name>[A-Za-z_][\w\\]*)?",
        {"function": "function", "class": "class", "interface": "interface", "trait": "trait", "enum": "enum", "namespace": "module"},
        r"^[ \t]*use\s+(?:function\s+|const\s+)?\\?(?P<what>[\w\\]+)",
        PHP, False, rf"(?:^|(?<=[{{;}}]))[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?\s*(?P<name>{NAME})\s*\(",
        (("extends", r"\bextends\s+([\w\\]+(?:\s*,\s*[\w\\]+)*)"), ("implements", r"\bimplements\s+([^{]+)")),
    ),
}


@dataclass
class Item:
    """An item at the top of a file or, with an owner, in a class; lines from 0, end excluded. The file itself, and an export without a name, have no symbol."""

    symbol: str | None
    kind: str
    start: int
    end: int
    calls: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    instantiates: list[str] = field(default_factory=list)
    owner: str | None = None
    doc: str | None = None


def blanked(text: str, rules: Rules) -> str:
    """The text with spaces in place of comments and strings; lines stay."""
    return re.sub(rules.skip, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int, lines_end: bool) -> int:
    """Where an item ends whose head ends at `at`: behind its first braces, its semicolon, or its line."""
    depth = 0
    for m in re.compile(r"[(){}\[\];\n]").finditer(text, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
            if depth == 0 and c == "}":
                return m.end()
        elif depth == 0 and (c == ";" or lines_end and c == "\n"):
            return m.end() if c == ";" else m.start()
    return len(text)


def _lists(found: list[str]) -> list[str]:
    return [n.strip().lstrip("\\") for part in found for n in part.split(",") if re.match(r"^\\?[A-Za-z_$][\w$\\.]*", n.strip())]


def _calls(text: str, rules: Rules, definitions: set[int]) -> tuple[list[str], list[str]]:
    """(called, instantiated) names, once each in order; heads of functions and methods are no calls."""
    called, made = {}, {}
    for m in re.finditer(rf"(?P<before>\bnew\s+\\?(?:\w+\\)*|\b(?:fn|function|func)\s+(?:\([^)]*\)\s*)?&?\*?)?(?P<name>{NAME})(?:::<[^>()]*>)?\s*\(", text):
        if m.start("name") in definitions or m["name"] in rules.words:
            continue
        before = m["before"] or ""
        if before.startswith("new"):
            made[m["name"]] = None
        elif not before:
            called[m["name"]] = None
    for m in re.finditer(rf"\bnew\s+\\?(?:\w+\\)*({NAME})", text):
        made[m[1]] = None
    return [c for c in called if len(c) >= 2], [n for n in made if n not in ("class", "static", "self")]


def _doc(text: str, at: int) -> str | None:
    """The comment lines right above a place."""
    lines, end = [], at
    while end > 0:
        start = text.rfind("\n", 0, end - 1) + 1
        line = text[start:end]
        if not re.match(r"[ \t]*(?:///?|/?\*+/?|#)", line):
            break
        lines.append(line)
        end = start
    return "".join(reversed(lines)).strip() or None


def items(text: str, language: str) -> list[Item]:
    """The file and its items, in order."""
    rules = LANGUAGES[language]
    plain = blanked(text, rules)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at)
    kept = {m.start() for m in re.finditer(rules.skip, text) if m[0][:1] in "\"'`"}
    own = Item(None, "file", 0, line(len(text)) + 1)
    for m in re.finditer(rules.imports, text, re.M):
        # an import inside a comment is blank, one in a longer string isn't a string's beginning
        if plain[m.start() : m.end()].strip() and (language in ("rust", "php") or _string_at(m, kept)) or language == "go" and _string_at(m, kept) and _in_import(plain, m.start()):
            own.imports.append(re.sub(r"\s+", " ", m["what"]).strip().lstrip("\\" if language == "php" else ""))
    out, covered, definitions = [own], 0, set()
    depth_at = _depths(plain)
    spans = []
    for m in re.finditer(rules.heads, plain, re.M):
        if m.start() < covered or depth_at(m.start()) > 0:
            continue
        end = closing(plain, m.end(), rules.lines_end and not (m["word"] in ("function", "class", "interface", "enum", "namespace", "func")))
        word = m["word"]
        name = m["name"] if word else m.groupdict().get("const")
        kind = rules.kinds[word] if word else "module"
        body = plain[m.start() : end]
        item = Item(name, kind, line(m.start()), line(max(m.start(), end - 1)) + 1, doc=_doc(text, m.start()))
        head = body.split("{")[0]
        if kind in ("class", "interface", "trait", "enum"):
            for how, pattern in rules.bases:
                getattr(item, how).extend(_lists(re.findall(pattern, head)))
        out.append(item)
        spans.append((m.start(), end))
        if rules.methods and kind in ("class", "interface", "trait", "enum") and "{" in body:
            definitions |= _methods(plain, m.start() + body.index("{"), end, rules, name, out, line)
        covered = end
    for item, (start, end) in zip([i for i in out[1:] if i.owner is None], spans):
        item.calls, item.instantiates = _calls(plain[start:end], rules, {d - start for d in definitions})
    rest = "".join(" " * (b - a) if inside else plain[a:b] for a, b, inside in _parts(len(plain), spans))
    own.calls, own.instantiates = _calls(rest, rules, set())
    return out


def _string_at(m: re.Match, kept: set[int]) -> bool:
    return m.start("what") - 1 in kept


def _in_import(plain: str, at: int) -> bool:
    """Whether a Go string stands in an import, alone or in parentheses."""
    before = plain[:at].rstrip()
    opened = before.rfind("import")
    return plain[at:].lstrip().startswith("import") or opened >= 0 and re.fullmatch(r"import\s*\((?:[\s\w._]*)", before[opened:]) is not None


def _depths(plain: str):
    """A function that gives the depth of braces at rising places."""
    marks = [(m.start(), 1 if m[0] == "{" else -1) for m in re.finditer(r"[{}]", plain)]
    state = [0, 0]

    def at(place: int) -> int:
        while state[0] < len(marks) and marks[state[0]][0] < place:
            state[1] = max(0, state[1] + marks[state[0]][1])
            state[0] += 1
        return state[1]

    return at


def _methods(plain: str, opened: int, end: int, rules: Rules, owner: str | None, out: list[Item], line) -> set[int]:
    """Adds the methods of a class body and gives the places of their names."""
    places, covered = set(), opened + 1
    depth_at = _depths(plain[opened:end])
    for m in re.compile(rules.methods, re.M).finditer(plain, opened + 1, end):
        if m.start() < covered or depth_at(m.start() - opened) != 1 or m["name"] in rules.words - {"constructor"}:
            continue
        close = closing(plain, m.end() - 1, False)
        if "{" not in plain[m.end() : close] and not plain[m.end() : close].rstrip().endswith(";"):
            continue
        places.add(m.start("name"))
        out.append(Item(m["name"], "method", line(m.start()), line(max(m.start(), close - 1)) + 1, owner=owner))
        covered = close
    return places


def _parts(n: int, spans: list[tuple[int, int]]):
    at = 0
    for a, b in spans:
        yield at, a, False
        yield a, b, True
        at = b
    yield at, n, False
