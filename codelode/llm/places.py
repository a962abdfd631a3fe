"""Where a bracket stands: what its level must hold, told from the tokens before it.

``placed`` names the tokens that count for something else on their level: an opening bracket becomes the name of
its place (``switch{``), a closing one the group it ends (``()`` empty, ``(.)`` with contents); others stay.
"""

from __future__ import annotations

from codelode.llm.lexing import CLOSE, OPEN

GROUPS = ("()", "(.)", "[]", "[.]", "{}", "{.}", "<>")
#: A semicolon inside the head of a statement in Go.
HEAD_MARK = "head;"
_CONTROL = {
    "java": frozenset(["if", "while", "switch", "synchronized", "for", "catch", "try"]),
    "js": frozenset(["if", "while", "switch", "with", "for", "catch", "await"]),
}
#: Names of places; every one is a token of its grammar or stands for the bracket alone.
TOKENS = (*GROUPS, HEAD_MARK, "block", "def(", "call(", "call[", "block{", "class{", "enum{", "init{", "switch{", "struct{", "interface{", "lit{", *(w + "(" for words in _CONTROL.values() for w in words))

#: Levels that are lists of statements or members, by the name their later parts go by.
LISTS = {
    "py": {"file": "block", "block": "block"},
    "java": {"block{": "block{", "class{": "class{"},
    "js": {"file": "block{", "block{": "block{", "class{": "class{"},
    "go": {"block{": "block{", "struct{": "struct{", "interface{": "interface{"},
    "json": {},
}
#: Tokens that end a statement on such a level, and tokens that go on with the one before all the same.
ENDS = {"py": ("nl", "<>"), "java": (";",), "js": (";", "nl"), "go": (";",), "json": ()}
GOES_ON = {"py": ("<>", "elif", "else", "except", "finally"), "java": ("else", "while", "catch", "finally"), "js": ("else", "while", "catch", "finally"), "go": (), "json": ()}

SIGNAL = {
    "py": frozenset(),
    "json": frozenset(),
    "java": frozenset(["class", "interface", "record", "enum", "new", ";"]),
    "js": frozenset(["class", "for", "while", "do", "break", "continue", "async", "await"]),
    "go": frozenset(["if", "for", "switch", "select", "func", ";"]),
}
SIGNAL = {lang: words | set(OPEN) | set(CLOSE) for lang, words in SIGNAL.items()}
_VALUE = frozenset(["id", ")", "]"])


class _Level:
    """An open bracket: what it is, the word before it, and what the statement on it has announced."""

    __slots__ = ("kind", "word", "pending", "loop", "switch")

    def __init__(self, kind: str, word: str = "", loop: bool = False, switch: bool = False) -> None:
        self.kind, self.word = kind, word
        self.pending: list[str] = []
        self.loop, self.switch = loop, switch


def placed(kinds: list[str], lang: str, signals: list[int] | None = None) -> dict[int, str]:
    """Tokens that go by another name on their level: place -> name. ``signals``: places of the kinds of SIGNAL, if known."""
    out: dict[int, str] = {}
    n = len(kinds)
    if signals is None:
        signals = [i for i, k in enumerate(kinds) if k in SIGNAL[lang]]
    if lang in ("py", "json"):
        for i in signals:
            k = kinds[i]
            if k in CLOSE:
                out[i] = _group(kinds, i, k)
            elif lang == "py":
                out[i] = _python(kinds, i, k)
        return out
    brace = {"java": _java, "js": _js, "go": _go}[lang]
    stack = [_Level("file")]
    ended: dict[int, _Level] = {}
    asynchronous = False
    for i in signals:
        k = kinds[i]
        top = stack[-1]
        before = kinds[i - 1] if i else "^"
        if k in CLOSE:
            out[i] = _group(kinds, i, k)
            if len(stack) > 1:
                ended[i] = stack.pop()
            continue
        if k == "{":
            kind, level = brace(kinds, i, before, top, ended.get(i - 1))
            out[i] = kind
            stack.append(level)
            continue
        if k in OPEN:
            if k == "(" and before in _CONTROL.get(lang, ()):
                out[i] = before + "("
            elif k == "[" and lang == "js" and (before in _VALUE or before in ("this", "super", "tpl")):
                out[i] = "call["
            word = before
            if lang == "js" and before == "await" and i > 1 and kinds[i - 2] == "for":
                word = "for"
            stack.append(_Level(k, word, top.loop, top.switch))
        elif lang == "js":
            if k in ("for", "while", "do"):
                top.loop = True  # a loop without braces: what follows on this level may be its body
            elif k == "class" and before != ".":
                top.pending = ["class"]
            elif k in ("break", "continue"):
                after = kinds[i + 1] if i + 1 < n else "$"
                if after != "id" and not (top.loop or k == "break" and top.switch) and before not in (".", "?.") and after not in (":", "(", "="):
                    out[i] = "err"
            elif k == "async":
                asynchronous = True
            elif k == "await" and not asynchronous:
                out[i] = "id"
        elif k == ";":
            top.pending = [x for x in top.pending if x not in ("new", "func", "class", "enum")]
            if top.pending:
                out[i] = HEAD_MARK
        elif lang == "java":
            if before != "." or k == "new":
                top.pending = [k if k in ("enum", "new") else "class"]
        elif k == "func":
            if before != "]":
                top.pending.append("func")
        else:
            top.pending.append(k)
    return out


def _group(kinds: list[str], i: int, k: str) -> str:
    o = CLOSE[k]
    if o == "indent":
        return "<>"
    return o + k if i and kinds[i - 1] == o else f"{o}.{k}"


def _python(kinds: list[str], i: int, k: str) -> str:
    if k == "indent":
        return "block"
    before = kinds[i - 1] if i else "^"
    if k == "(":
        if i > 1 and kinds[i - 2] == "def":
            return "def("
        # The bracket after the type parameters of a function holds parameters too.
        if before == "]" and (o := _opened(kinds, i - 1)) > 1 and kinds[o - 2] == "def":
            return "def("
        return "call(" if before in _VALUE or before == "str" else k
    if k == "[":
        return "call[" if before in _VALUE or before in ("str", "}") else k
    return k


def _opened(kinds: list[str], i: int) -> int:
    """Place of the square bracket that ``i`` closes; -1 if a line ends before."""
    depth = 0
    for j in range(i, -1, -1):
        depth += (kinds[j] == "]") - (kinds[j] == "[")
        if not depth:
            return j
        if kinds[j] == "nl":
            break
    return -1


def _java(kinds: list[str], i: int, before: str, top: _Level, group: _Level | None) -> tuple[str, _Level]:
    pending = top.pending[-1] if top.pending else ""
    if before == "]" and top.kind == "class{" and kinds[i - 3 : i - 2] == [")"]:
        return "block{", _Level("block{")  # of a method whose brackets follow its parameters
    if before in ("=", "]", "(", "default") or before in (",", "{") and top.kind in ("init{", "("):
        return "init{", _Level("init{")
    if before == "->" or before in ("do", "else", "try", "finally", "static"):
        return "block{", _Level("block{")
    if before == ")" and group is not None and group.word in _CONTROL["java"]:
        kind = "switch{" if group.word == "switch" else "block{"
        return kind, _Level(kind)
    if before in ("id", ">", ")") and pending in ("class", "enum", "new"):
        if pending != "new":
            top.pending = []
        elif before != ")":
            return "{", _Level("{")
        kind = "enum{" if pending == "enum" else "class{"
        return kind, _Level(kind)
    if top.kind == "enum{" or top.kind == "{" or before in (",", "]"):
        return "{", _Level("{")
    return "block{", _Level("block{")


def _js(kinds: list[str], i: int, before: str, top: _Level, group: _Level | None) -> tuple[str, _Level]:
    if top.pending and before != "extends":
        top.pending = []
        return "class{", _Level("class{")
    if before == ")" and group is not None:
        if group.word == "switch":
            return "switch{", _Level("switch{", loop=top.loop, switch=True)
        if group.word in _CONTROL["js"]:
            return "block{", _Level("block{", loop=top.loop or group.word in ("for", "while"), switch=top.switch)
        return "block{", _Level("block{")  # of a function
    if before == "=>" or before == "id" and top.kind == "class{":
        return "block{", _Level("block{")
    if before in ("do", "else", "try", "finally"):
        return "block{", _Level("block{", loop=top.loop or before == "do", switch=top.switch)
    return "{", _Level("{", loop=top.loop, switch=top.switch)


def _go(kinds: list[str], i: int, before: str, top: _Level, group: _Level | None) -> tuple[str, _Level]:
    if before in ("struct", "interface"):
        return before + "{", _Level(before + "{")
    pending = top.pending[-1] if top.pending else ""
    if before == "else":
        return "block{", _Level("block{")
    if pending and not (pending != "func" and _literal_type(kinds, i)):
        top.pending.pop()
        kind = "switch{" if pending in ("switch", "select") else "block{"
        return kind, _Level(kind)
    if before in ("id", "]", "}"):
        return "lit{", _Level("lit{")
    if top.kind == "lit{" or before == ")":
        return ("lit{", _Level("lit{")) if top.kind == "lit{" else ("{", _Level("{"))
    return "block{", _Level("block{")


def _literal_type(kinds: list[str], i: int) -> bool:
    """Whether what stands before a brace is a type that starts with square brackets, as in ``[]pkg.T``."""
    j = i - 1
    if j >= 0 and kinds[j] == "}":
        depth = 0
        while j >= 0:
            depth += (kinds[j] == "}") - (kinds[j] == "{")
            if not depth:
                return j > 1 and kinds[j - 1] in ("struct", "interface") and kinds[j - 2] in ("]", "*")
            j -= 1
        return False
    if j < 0 or kinds[j] != "id":
        return False
    j -= 1
    if j > 0 and kinds[j] == "." and kinds[j - 1] == "id":
        j -= 2
    while j >= 0 and kinds[j] == "*":
        j -= 1
    return j >= 0 and kinds[j] == "]"
