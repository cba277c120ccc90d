"""Functions and classes of languages with braces: C, C++, C#, Java, JavaScript, TypeScript, Go, Rust, PHP, Swift, Scala.

Not a grammar: comments and literals are blanked out, then every brace is judged by what stands before it, back to the
last statement. It is a class if a word for one and a name are there, a function if a name with a parameter list is, and
else a block. A function ends at its closing brace. Functions without braces (`x => x + 1`) are not found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .text import LANGUAGES

BRACED = ("c", "cpp", "c_sharp", "java", "javascript", "jsx", "typescript", "tsx", "go", "rust", "php", "swift", "scala")

_QUIET = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TEXTS = r'"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`'
_LETTERS = {"rust": r"'(?:\\[^']+|[^'\\\n])'"}
_LETTER = r"'(?:\\.|[^'\\\n])*'"
_CLASS = re.compile(r"\b(?:class|interface|struct|trait|enum|union|protocol|object|impl(?:\s*<[^{]*?>)?(?:\s+[\w:<>, ]+\s+for)?|namespace)\s+([A-Za-z_$][\w$]*)")
_BASES = re.compile(r"\b(?:extends|implements)\s+([\w$.,<> ]+)|(?<!:):(?!:)\s*([\w$.,:<> ]+)$")
_LIST = r"\(([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*)\)"
_ASSIGNED = re.compile(rf"([\w$.\[\]'\"-]+)\s*[:=]\s*(?:async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*)?(?:{_LIST}|([\w$]+))\s*(:[^=]+)?(?:=>)?\s*$")
_NAMED = re.compile(rf"([A-Za-z_$~][\w$~]*(?:::[A-Za-z_~][\w~]*)*)\s*(?:<[^<>()]*>)?\s*{_LIST}([^()]*(?:\([^()]*\)[^()]*)*)$")
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)\s*(?:<[\w, ]+>)?\(")
_BRANCH = re.compile(r"\b(?:if|for|foreach|while|case|catch|guard)\b")
_CHOICE = re.compile(r"&&|\|\||\?(?![.?:])")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_IMPORT = re.compile(r"^\s*(?:#\s*include\s*[<\"]([^>\"]+)|import\s+[^;\n]*?from\s+['\"]([^'\"]+)|import\s+(?:static\s+)?['\"]?([\w.*/@-]+)|using\s+([\w.]+)\s*;|use\s+([\w:\\]+)|.*?require\(\s*['\"]([^'\"]+))", re.M)
#: Words before a parameter list that are no function's name.
_CONTROL = set("if for foreach while switch catch return new else do try sizeof throw await yield function match loop unless guard using lock synchronized with in of typeof delete defined func fn super this".split())


@dataclass
class _Open:
    kind: str
    start: int = 0
    name: str = ""
    header: str = ""
    parameters: str = ""
    after: str = ""
    bases: list[str] = field(default_factory=list)


def blanked(source: str, language: str) -> tuple[str, str, list[tuple[int, int]]]:
    """The source with comments and literals as spaces, that with only comments as spaces, and where the comments are.

    Breaks are kept, so places are the same in all three.
    """
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m[0].startswith(("//", "/*")):
            comments.append(m.span())
        return re.sub(r"[^\n]", " ", m[0])

    plain = re.sub("|".join((_QUIET, _TEXTS, _LETTERS.get(language, _LETTER))), blank, source, flags=re.S)
    spoken, at = [], 0
    for a, b in comments:
        spoken += [source[at:a], plain[a:b]]
        at = b
    return plain, "".join([*spoken, source[at:]]), comments


def _judge(header: str, spoken: str, language: str) -> _Open:
    """What a brace opens, by the text before it, without and with its literals."""
    flat = header.rstrip()
    shift = len(flat) - len(flat.lstrip())
    flat, spoken = flat[shift:], spoken[shift : len(flat)]
    within = lambda m, g: spoken[m.start(g) : m.end(g)] if m[g] is not None else ""
    if language == "go" and (m := re.search(rf"\bfunc\s*(?:\(([^()]*)\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*{_LIST}(.*)$", flat)):
        found = _Open("function", name=m[2], parameters=within(m, 3), after=m[4], header=flat)
        found.bases = [m[1].split()[-1].lstrip("*")] if m[1] else []
        return found
    named = _NAMED.search(flat)
    assigned = _ASSIGNED.search(spoken) if language in ("javascript", "jsx", "typescript", "tsx") else None
    if assigned and ("=>" in flat or re.search(r"\bfunction\b", flat)) and not re.search(r"\bfunction\s*\*?\s*[\w$]+\s*\(", flat):
        return _Open("function", name=assigned[1].strip("'\"").rsplit(".prototype.", 1)[-1].removeprefix("module.exports.").removeprefix("exports."), parameters=assigned[2] if assigned[2] is not None else assigned[3] or "", after=assigned[4] or "", header=flat)
    if (m := _CLASS.search(flat)) and not (named and named.start() > m.end()) and "(" not in flat[: m.start()]:
        rest = _BASES.search(flat[m.end() :])
        bases = [b.strip() for b in re.split(r",|\bimplements\b", (rest[1] or rest[2]) if rest else "") if b.strip()]
        return _Open("class" if not flat.startswith("namespace") else "block", name=m[1], bases=bases, header=flat)
    if named and named[1].split("::")[-1] not in _CONTROL and "=" not in flat[: named.start()] and not re.search(r"\b(?:new|return|throw|else)\s*$", flat[: named.start()]):
        return _Open("function", name=named[1], parameters=within(named, 2), after=named[3], header=flat)
    return _Open("block")


def _parameters(text: str, language: str) -> list[dict]:
    parts, depth, at = [], 0, ""
    for c in text:
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            parts.append(at)
            at = ""
        else:
            at += c
    rows = []
    for part in filter(None, (p.strip() for p in [*parts, at])):
        left, _, default = part.partition("=")
        left = left.strip()
        if language in ("typescript", "tsx", "javascript", "jsx", "rust", "swift", "scala"):
            name, _, kind = left.partition(":")
            name = name.split()[-1] if name.split() else name
        elif language == "go":
            name, _, kind = left.partition(" ")
        else:
            kind, _, name = left.rpartition(" ")
        if name == "void" and not kind:
            continue
        pointer = re.match(r"[*&.$]*", name)[0] if language not in ("php", "javascript", "jsx", "typescript", "tsx") else ""
        rows.append({"name": name[len(pointer) :].strip("?"), "type": (kind + pointer).strip() or None, "default": default.strip() or None})
    return rows


def _returns(one: _Open, language: str) -> str | None:
    after = one.after.strip()
    if language in ("typescript", "tsx", "scala", "php"):
        return after.removeprefix(":").removesuffix("=>").removesuffix("=").strip() or None if after.startswith(":") else None
    if language in ("rust", "swift"):
        return after.split("where")[0].removeprefix("->").strip() or None if after.startswith("->") else None
    if language == "go":
        return after or None
    if language in ("javascript", "jsx"):
        return None
    before = one.header.split(one.name + "(")[0].split(one.name + " (")[0]
    words = [w for w in re.sub(r"@\w+(?:\([^)]*\))?|\[[^\]]*\]", " ", before).split() if w not in "public private protected static final inline virtual abstract override extern async const constexpr synchronized native unsafe internal sealed partial".split()]
    return " ".join(words) or None


def parse(path: str, source: str, language: str) -> tuple[list[dict], list[dict]]:
    """Function rows and class rows of one file, in the order of their lines."""
    plain, spoken, comments = blanked(source, language)
    imports = list(dict.fromkeys(next(g for g in m.groups() if g) for m in _IMPORT.finditer(source)))
    breaks = [m.start() for m in re.finditer("\n", source)]
    from bisect import bisect_left

    line = lambda at: bisect_left(breaks, at) + 1
    functions, classes, stack, last, round_ = [], [], [], 0, 0
    for m in re.finditer(r"[{};()]", plain):
        c, at = m[0], m.start()
        if c in "()":
            round_ += 1 if c == "(" else -1
        elif c == ";" and round_ <= 0:
            last, round_ = at + 1, 0
        elif c == "{":
            one = _judge(plain[last:at], spoken[last:at], language)
            one.start = last + len(plain[last:at]) - len(plain[last:at].lstrip())
            stack.append((one, round_))
            last, round_ = at + 1, 0
        elif c == "}" and stack:
            one, round_ = stack.pop()
            end, last = at + 1, at + 1
            above = [o.name for o, _ in stack if o.kind == "class"]
            if one.kind == "class":
                classes.append({"file_path": path, "class_name": one.name, "bases": one.bases, "start_line": line(one.start), "end_line": line(at), "methods": []})
            elif one.kind == "function":
                owner = one.name.rpartition("::")[0].split("::")[-1] or (above[-1] if above else None) or (one.bases[0] if one.bases else None)
                functions.append(_row(path, source, plain, comments, imports, one, end, owner, line, language))
    for row in classes:
        row["methods"] = [f["name"] for f in sorted(functions, key=lambda f: f["start_line"]) if f["parent_class"] == row["class_name"]]
    by_line = lambda rows: sorted(rows, key=lambda r: r["start_line"])
    return by_line(functions), by_line(classes)


def _row(path: str, source: str, plain: str, comments: list, imports: list[str], one: _Open, end: int, owner: str | None, line, language: str) -> dict:
    body = plain[plain.index("{", one.start + len(plain[one.start : end].split("{", 1)[0])) : end]
    offset = end - len(body)
    calls = []
    for m in _CALL.finditer(body):
        name = re.split(r"\.|::|->", m[1].replace("?.", "."))[-1]
        if name in _CONTROL or m[1] in _CONTROL:
            continue
        depth = 0
        for k in range(m.end() - 1, len(body)):
            depth += (body[k] == "(") - (body[k] == ")")
            if not depth:
                break
        calls.append({"name": name, "full_call": source[offset + m.start() : offset + k + 1]})
    branches = len(_BRANCH.findall(body))
    depth = deepest = 0
    for c in body:
        depth += (c in "{([") - (c in "})]")
        deepest = max(deepest, depth)
    near = [source[a:b] for a, b in comments if one.start <= a < end]
    before = [source[a:b] for a, b in comments if b <= one.start and not plain[b : one.start].strip() and "\n\n" not in source[b : one.start]]
    return {
        "file_path": path, "name": one.name.rpartition("::")[2], "parent_class": owner, "start_line": line(one.start), "end_line": line(end - 1), "code": source[one.start : end], "docstring": None,
        "return_type": _returns(one, language), "parameters": _parameters(one.parameters, language), "imports": imports, "calls": calls, "cyclomatic_complexity": 1 + branches + len(_CHOICE.findall(body)),
        "lines_of_code": sum(bool(x.strip()) for x in plain[one.start : end].splitlines()), "token_count": len(_TOKEN.findall(plain[one.start : end])), "branch_count": branches, "syntax_depth": deepest,
        "is_async": bool(re.search(r"\basync\b", one.header)), "decorators": re.findall(r"@(\w+)", one.header), "comments": before[-1:] + near,
    }


def language_of(path: str) -> str | None:
    """The language of a path, None if it is unknown."""
    m = re.search(r"[^/](\.[^./]+)$", path)
    return LANGUAGES.get(m[1]) if m else None
