"""Lexers: source text to token kinds with offsets, for Python, Java, JavaScript, Go and JSON.

A kind is ``id``, ``num``, ``str``, a keyword, an operator, a bracket, or one of the layout kinds
(``nl``, ``indent``, ``dedent``); ``err`` stands for text no token fits. A JavaScript template with
substitutions is ``tpl`` followed by one square bracket group for each of them.

A text is cut into pieces (blanks and the token after them) by one regular expression; the kind
of a piece is looked up, so that a word is classified once however often it occurs.
"""

from __future__ import annotations

import re
from itertools import accumulate

# Reserved words of the languages.
KEYWORDS = {
    "py": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "js": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "json": "true false null",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
LANGUAGES = {".py": "py", ".java": "java", ".js": "js", ".go": "go", ".json": "json"}

# Operators of the languages.
OPERATORS = {
    "py": "**= //= >>= <<= ... -> := ** // >> << <= >= == != += -= *= /= %= &= |= ^= @= - + * / % @ & | ^ ~ < > = . , : ;",
    "java": "... -> :: ++ -- && || <<= << <= >= == != += -= *= /= %= &= |= ^= - + * / % & | ^ ~ ! < > = ? . , : ; @",
    "js": "... => >>>= >>> **= ** &&= || ||= ??= ?? ?. && === !== ++ -- <<= >>= << >> <= >= == != += -= *= /= %= &= |= ^= - + * / % & | ^ ~ ! < > = ? . , : ; #",
    "go": "... <- := &^= &^ ++ -- && || <<= >>= << >> <= >= == != += -= *= /= %= &= |= ^= - + * / % & | ^ ~ ! < > = . , : ;",
    "json": ", :",
}
OPERATORS = {k: v.split() for k, v in OPERATORS.items()}

_ID = r"[^\W\d]\w*+"
_EXP = r"[eE][+-]?\d(?:_?\d)*"
_DIGITS = r"\d(?:_?\d)*"
_HEX = r"0[xX]_?[0-9a-fA-F](?:_?[0-9a-fA-F])*"
_FLOAT = rf"(?:(?:{_DIGITS})?\.{_DIGITS}(?:{_EXP})?|{_DIGITS}\.(?:{_EXP})?|{_DIGITS}{_EXP})"
#: Decimal numbers do not start with a zero in Python, Java (an octal) and Go (the same).
_NUM = {
    "py": rf"(?:{_HEX}|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|{_FLOAT}[jJ]?|{_DIGITS}[jJ]|[1-9](?:_?\d)*|0(?:_?0)*)",
    "java": rf"(?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|{_FLOAT}[fFdD]?|{_DIGITS}[fFdD]|(?:[1-9](?:_*\d)*|0(?:_*[0-7])*)[lL]?)",
    "js": rf"(?:{_HEX}n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|{_FLOAT}|{_DIGITS}n?)",
    "go": rf"(?:{_HEX}|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|{_FLOAT}i?|{_DIGITS}i|[1-9](?:_?\d)*|0(?:_?[0-7])*)",
    "json": r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?",
}
_ESC = r"\\(?:[btnfrs0-7\"'\\\n]|u+[0-9a-fA-F]{4})"
_STR = {
    "java": rf'"""[ \t\f]*\r?\n(?:[^\\"]|\\.|"(?!""))*"""|"(?:[^"\\\r\n]|{_ESC})*"|\'(?:[^\'\\\r\n]|{_ESC}[0-7]{{0,2}})\'',
    "js": r'"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|\'(?:[^\'\\\r\n]|\\(?:\r\n|[\s\S]))*\'',
    "go": r'`[^`]*`|"(?:[^"\\\r\n]|\\(?:[abfnrtv\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))*"|\'(?:[^\'\\\r\n]|\\(?:[abfnrtv\\\']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))\'',
    "json": r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"',
}
_PY_PREFIX = r"(?:[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF]|[rRuUbBfF])?"
_STR["py"] = _PY_PREFIX + r'(?:"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|\'(?!\'\')(?:[^\'\\\r\n]|\\(?:\r\n|[\s\S]))*\')'
_COMMENT = {"py": r"#[^\r\n]*", "java": r"//[^\r\n]*|/\*[\s\S]*?\*/", "js": r"//[^\r\n]*|/\*[\s\S]*?\*/", "go": r"//[^\r\n]*|/\*[\s\S]*?\*/", "json": r"(?!)"}
_SPACE = {"py": r"[ \t\f]|\\\r?\n", "json": r"[ \t\r\n]"}
_WORD = {"py": _ID, "go": _ID, "json": r"[A-Za-z_]\w*+", "java": r"non-sealed(?![\w$])|(?:[^\W\d]|\$)[\w$]*+", "js": r"(?:[^\W\d]|\$)[\w$]*+"}


def _parts(lang: str) -> tuple[str, str]:
    """Regular expressions of the blanks before a token, and of the token with named groups."""
    line = r"(?!)" if lang == "json" else r"\r\n|\r|\n"
    ops = "|".join(re.escape(x) + (r"(?!\d)" if x == "?." else "") for x in sorted(OPERATORS[lang], key=len, reverse=True))
    # A word is met most often and so tried first; one that a quote follows may be the prefix of a string.
    # A digit glued to letters, as 12abc, is no token of any of these languages.
    early = r"(?![\"'])" if lang == "py" else ""
    token = rf"(?P<word>(?:{_WORD[lang]}){early})|(?P<line>{line})|(?P<br>[()\[\]{{}}])|(?P<comment>{_COMMENT[lang]})|(?P<str>{_STR[lang]})|(?P<num>{_NUM[lang]}(?![\w$]))|(?P<id>{_WORD[lang]})|(?P<op>{ops})|(?P<err>[\s\S])"
    return _SPACE.get(lang, r"[^\S\r\n]|\ufeff"), token


#: Forms of most tokens, tried before the full list; what such a piece is, the full list says.
_SIGNS = {"py": r"[,;:=+\-*/%<>&|^@~](?![-+*/%@&|^~<>=.:])|\.(?![\d.])", "json": r"[,:]"}
_PLAIN_STR = {"py": r"\"[^\"\\\r\n]++\"|'[^'\\\r\n]++'", "java": r"\"[^\"\\\r\n]++\"", "json": r"\"[^\"\\\x00-\x1f]*+\""}


def _piece(lang: str) -> re.Pattern[str]:
    space, token = _parts(lang)
    space = rf"(?:{space})*+" if lang == "json" else r"[ \t\f]*+(?:\\\r?\n[ \t\f]*+)*+" if lang == "py" else r"[^\S\r\n]*+(?:\ufeff[^\S\r\n]*+)*+"
    # A number takes all letters and digits that follow, so that a piece is what it is without its neighbours.
    token = re.sub(r"[?]P<[a-z]+>", "?:", token.replace(r"(?![\w$]))|(?P<id>", r"[\w$]*+)|(?P<id>"))
    word, _, rest = token.partition("|(?:" + ("(?!)" if lang == "json" else r"\r\n"))
    signs = _SIGNS.get(lang, r"[,;:=+\-*/%<>&|^!?~](?![-+*/%@&|^~<>=.:!?])|\.(?![\d.])")
    strings = _PLAIN_STR.get(lang, _PLAIN_STR["java"] if lang == "go" else _PLAIN_STR["py"])
    return re.compile(rf"{space}(?:{word}|{signs}|\r?\n|[()\[\]{{}}]|{strings}|\d++(?![\w$.+-])|{token}|\Z)")


_PIECES = {lang: _piece(lang) for lang in KEYWORDS}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_BLANKS = re.compile(r"[ \t\f]*")

#: Kinds that are no tokens: nothing, a line break, a comment, a comment with a line break.
SKIP, LINE, COMMENT, LINES = "", "\n", "#", "#\n"
_DROPPED = frozenset([SKIP, LINE, COMMENT, LINES])

_WORDS_AFTER = frozenset(["id", "num", "str", "tpl", "(", "[", "{", "this", "new", "null", "true", "false", "None", "True", "False", "-", "not", "lambda", "*", "await", "function", "!", "super"])
#: Words that are reserved only where the next token (second set) lets them be.
_CONTEXT = {
    "js": {"let": frozenset(["id", "[", "{", "async", "of"]), "async": frozenset(["function", "id", "("]), "await": _WORDS_AFTER, "yield": _WORDS_AFTER | {")", ";"}, "of": _WORDS_AFTER},
    "java": {"record": frozenset(["id"]), "sealed": frozenset(["class", "interface", "abstract"]), "permits": frozenset(["id"]), "yield": frozenset(["id", "num", "str", "new", "true", "false", "null", "this", "!"])},
    "py": {"match": _WORDS_AFTER, "case": _WORDS_AFTER, "type": frozenset(["id"])},
}
#: Such a word has the kind ``?word`` until its place is looked at.
_MAYBE = frozenset("?" + w for words in _CONTEXT.values() for w in words)


class _Kinds(dict):
    """Piece to kind; long pieces and more than ``most`` of them are classified anew each time."""

    most = 400_000

    def __init__(self, lang: str) -> None:
        self.lang = lang
        space, token = _parts(lang)
        self.blank, self.token = re.compile(rf"(?:{space})*+"), re.compile(token)

    def __missing__(self, piece: str) -> str:
        at = self.blank.match(piece, 1 if piece[:1] == "\ufeff" and self.lang != "json" else 0).end()
        if at == len(piece):
            kind = SKIP
        else:
            m = self.token.match(piece, at)
            group, text = m.lastgroup if m.end() == len(piece) else "err", m.group()
            if group in ("word", "id"):
                kind = text if text in KEYWORDS[self.lang] else "sealed" if text == "non-sealed" else "?" + text if text in _CONTEXT.get(self.lang, ()) else "id"
            elif group in ("op", "br"):
                kind = text
            elif group == "line":
                kind = LINE
            elif group == "comment":
                kind = LINES if "\n" in text else COMMENT
            else:
                kind = group
        if len(piece) < 48 and len(self) < self.most:
            self[piece] = kind
        return kind


_KINDS = {lang: _Kinds(lang) for lang in KEYWORDS}

#: After these kinds a slash in JavaScript divides; after others it opens a pattern.
_VALUE_END = frozenset(["id", "num", "str", "tpl", ")", "]", "}", "this", "super", "null", "true", "false"]) | _MAYBE
_JS_END = _VALUE_END | {"return", "break", "continue", "++", "--", "debugger"}
_JS_GOES_ON = frozenset(". ?. , ; : ? ) ] } + - * / % = == === != !== < > <= >= & | ^ && || ?? ?: => ( [ instanceof in += -= *= /= %= &= |= ^= ** **= >> << >>> else catch finally".split())
_GO_END = frozenset(["id", "num", "str", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "indent": "dedent"}, {")": "(", "]": "[", "}": "{", "dedent": "indent"}

Token = tuple[str, int, int]


class Lexed:
    """Kinds of a text's tokens, and where they stand.

    ``at`` holds for each token its piece, or ``~piece`` for a token without characters before that piece.
    """

    __slots__ = ("pieces", "kinds", "at", "_ends")

    def __init__(self, pieces: list[str], kinds: list[str], at: list[int]) -> None:
        self.pieces, self.kinds, self.at = pieces, kinds, at
        self._ends: list[int] | None = None

    def span(self, i: int) -> tuple[int, int]:
        """First and last offset of token ``i``, without blanks."""
        if self._ends is None:
            self._ends = [*accumulate(map(len, self.pieces), initial=0)]
        p = self.at[i]
        if p >= 0:
            a, b = self._ends[p], self._ends[p + 1]
            return a + _lead(self.pieces[p]), b
        p = ~p
        if p >= len(self.pieces):
            return self._ends[-1], self._ends[-1]
        a = self._ends[p] + _lead(self.pieces[p])
        return a, a

    def text(self, i: int) -> str:
        p = self.at[i]
        return self.pieces[p][_lead(self.pieces[p]) :] if p >= 0 else ""

    def tokens(self) -> list[Token]:
        return [(k, *self.span(i)) for i, k in enumerate(self.kinds)]


def _lead(piece: str) -> int:
    """Characters before the token of a piece. Where all are blank, the token is the line break at the end."""
    rest = piece.lstrip()
    while rest[:1] == "\ufeff" or rest[:1] == "\\" and rest[1:2] in ("\r", "\n"):
        rest = rest[1:].lstrip()
    return len(piece) - (len(rest) or (2 if piece.endswith("\r\n") else 1))


def scan(text: str, lang: str, comments: bool = False) -> Lexed:
    """Tokens of ``text``. With ``comments``, comments are tokens too (kind ``comment``).

    Layout: Go gets its automatic ``;``; JavaScript gets ``nl`` where a line break may end a
    statement; Python gets ``nl``, ``indent`` and ``dedent``. Inside round and square brackets
    JavaScript and Python have no layout.
    """
    if lang == "js":
        got = _scan_js(text, comments)
    else:
        pieces = _PIECES[lang].findall(text)
        if lang == "py" and text[:1] == "\ufeff":
            pieces = _PIECES[lang].findall(text, 1)
            pieces[0] = "\ufeff" + pieces[0]
        kinds = [*map(_KINDS[lang].__getitem__, pieces)]
        if lang == "py":
            got = _layout_python(pieces, kinds, comments)
        elif lang == "go":
            got = _layout_go(pieces, kinds, comments)
        elif comments:
            keep = [i for i, k in enumerate(kinds) if k != SKIP and k != LINE]
            got = Lexed(pieces, ["comment" if kinds[i] in _DROPPED else kinds[i] for i in keep], keep)
        else:
            keep = [i for i, k in enumerate(kinds) if k not in _DROPPED]
            got = Lexed(pieces, [kinds[i] for i in keep], keep)
    if "err" in got.kinds:
        _join_errors(got)
    if lang in _CONTEXT and any(w in text for w in _CONTEXT[lang]):
        _contextual(got, lang)
    return got


def _join_errors(got: Lexed) -> None:
    """Neighbouring pieces that no token fits are one ``err``; its place is the first."""
    kinds, at = [], []
    for k, p in zip(got.kinds, got.at):
        if k == "err" and kinds and kinds[-1] == "err" and at[-1] >= 0 and p >= 0 and not _lead(got.pieces[p]):
            continue
        kinds.append(k)
        at.append(p)
    got.kinds, got.at = kinds, at


def _layout_go(pieces: list[str], kinds: list[str], comments: bool) -> Lexed:
    out: list[str] = []
    at: list[int] = []
    last = ""
    for i, k in enumerate(kinds):
        if k not in _DROPPED:
            out.append(k)
            at.append(i)
            last = k
            continue
        if comments and (k == COMMENT or k == LINES):
            out.append("comment")
            at.append(i)
        if (k == LINE or k == LINES) and last in _GO_END:
            out.append(";")
            at.append(~i)
            last = ";"
    if last in _GO_END:
        out.append(";")
        at.append(~len(pieces))
    return Lexed(pieces, out, at)


def _layout_python(pieces: list[str], kinds: list[str], comments: bool) -> Lexed:
    out: list[str] = []
    at: list[int] = []
    stack = [(0, 0)]
    depth = 0
    fresh, begun = True, False  # at a line's start; whether the line has tokens
    for i, k in enumerate(kinds):
        if k == LINE:
            if not depth:
                if begun:
                    out.append("nl")
                    at.append(i)
                    begun = False
                fresh = True
            continue
        if k == COMMENT:
            if comments:
                out.append("comment")
                at.append(i)
            fresh = False
            continue
        if k == SKIP:
            continue
        if fresh:
            fresh = False
            if not depth:
                lead = _BLANKS.match(pieces[i].lstrip("\ufeff")).group()
                if "\t" in lead or "\f" in lead:
                    width, alt = 0, 0
                    for c in lead:
                        width, alt = ((width // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0) if c == "\f" else (width + 1, alt + 1)
                else:
                    width = alt = len(lead)
                if (width, alt) != stack[-1]:
                    _indent(out, at, stack, width, alt, ~i)
        out.append(k)
        at.append(i)
        begun = True
        if k in "([{":
            depth += 1
        elif k in ")]}" and depth:
            depth -= 1
    if begun:
        out.append("nl")
        at.append(~len(pieces))
    for _ in stack[1:]:
        out.append("dedent")
        at.append(~len(pieces))
    return Lexed(pieces, out, at)


def _indent(out: list[str], at: list[int], stack: list[tuple[int, int]], width: int, alt: int, place: int) -> None:
    top = stack[-1]
    if (width > top[0]) != (alt > top[1]) or (width == top[0]) != (alt == top[1]):
        out.append("err")  # tabs and blanks disagree
        at.append(place)
        stack[-1] = (width, alt)
    elif width > top[0]:
        stack.append((width, alt))
        out.append("indent")
        at.append(place)
    else:
        while width < stack[-1][0]:
            stack.pop()
            out.append("dedent")
            at.append(place)
        if (width, alt) != stack[-1]:
            stack.append((width, alt))
            out += ["err", "indent"]  # no such level above
            at += [place, place]


_TEXT = re.compile(r"(?:[^\\`$]|\\[\s\S]|\$(?!\{))*+")


def _layout_js(pieces: list[str], kinds: list[str], comments: bool) -> Lexed:
    """Layout where no piece hangs on the ones before it: no template, and no slash that may open a pattern."""
    out: list[str] = []
    at: list[int] = []
    last = ""
    broke = False
    depth: list[str] = []
    for i, k in enumerate(kinds):
        if k in _DROPPED:
            if k == LINE or k == LINES:
                broke = True
            if comments and (k == COMMENT or k == LINES):
                out.append("comment")
                at.append(i)
            continue
        if broke:
            broke = False
            if last in _JS_END and k not in _JS_GOES_ON and (not depth or depth[-1] == "{"):
                out.append("nl")
                at.append(~i)
        if k in "([{":
            depth.append(k)
        elif k in ")]}" and depth:
            depth.pop()
        if (last == "." or last == "?.") and (k[0].isalpha() or k in _MAYBE) and k not in ("num", "str", "err"):
            k = "id"
        out.append(k)
        at.append(i)
        last = k
    return Lexed(pieces, out, at)


def _scan_js(text: str, comments: bool) -> Lexed:
    if "`" not in text and not text.startswith("#!", 1 if text[:1] == "\ufeff" else 0):
        pieces = _PIECES["js"].findall(text)
        plain = [*map(_KINDS["js"].__getitem__, pieces)]
        if "/" not in plain and "/=" not in plain:
            return _layout_js(pieces, plain, comments)
    pieces: list[str] = []
    out: list[str] = []
    at: list[int] = []
    kinds, pattern = _KINDS["js"], _PIECES["js"]
    last = ""
    broke = False
    depth: list[str] = []  # open brackets; a backquote for a substitution of a template
    pos, n = 0, len(text)
    if text.startswith("#!", 1 if text[:1] == "\ufeff" else 0):
        pos = len(text.split("\n", 1)[0])
        pieces.append(text[:pos])

    def template(start: int) -> int:
        """Reads a template's characters from ``start`` to its end or its next substitution."""
        nonlocal last
        end = _TEXT.match(text, start).end()
        if text.startswith("`", end):
            last = "tpl"
            return end + 1
        if end >= n:
            out.append("err")
            at.append(len(pieces))
            return n
        out.append("[")
        at.append(~len(pieces))
        depth.append("`")
        last = "["
        return end + 2

    while pos < n:
        again = -1
        for m in iter(pattern.scanner(text, pos).match, None):
            piece = m.group()
            k = kinds[piece]
            if k in _DROPPED:
                if k == LINE or k == LINES:
                    broke = True
                if comments and (k == COMMENT or k == LINES):
                    out.append("comment")
                    at.append(len(pieces))
                pieces.append(piece)
                continue
            if k == "err" and piece[-1] == "`":
                if broke and last in _JS_END and (not depth or depth[-1] == "{"):
                    out.append("nl")
                    at.append(~len(pieces))
                broke = False
                out.append("tpl")
                at.append(len(pieces))
                again = template(m.end())
                pieces.append(text[m.start() : again])
                break
            if k[0] == "/" and last not in _VALUE_END and (r := _REGEX.match(text, m.end() - len(k))):
                if broke and last in _JS_END and (not depth or depth[-1] == "{"):
                    out.append("nl")
                    at.append(~len(pieces))
                out.append("str")
                at.append(len(pieces))
                pieces.append(text[m.start() : r.end()])
                last, broke, again = "str", False, r.end()
                break
            if broke:
                broke = False
                if last in _JS_END and k not in _JS_GOES_ON and (not depth or depth[-1] == "{"):
                    out.append("nl")
                    at.append(~len(pieces))
            if k in "([{":
                depth.append(k)
            elif k in ")]}" and depth:
                if depth.pop() == "`" and k == "}":
                    # The substitution ends; the template goes on.
                    out.append("]")
                    at.append(~len(pieces))
                    again = template(m.end())
                    pieces.append(text[m.start() : again])
                    break
            if (last == "." or last == "?.") and (k[0].isalpha() or k in _MAYBE) and k not in ("num", "str", "err"):
                k = "id"
            out.append(k)
            at.append(len(pieces))
            pieces.append(piece)
            last = k
        if again < 0:
            break
        pos = again
    return Lexed(pieces, out, at)


def _contextual(got: Lexed, lang: str) -> None:
    """Decides of every word that is reserved in some places only."""
    words, out = _CONTEXT[lang], got.kinds
    marked = [i for i, k in enumerate(out) if k in _MAYBE]
    named = {}
    for i in marked:
        named[i] = out[i][1:]
        out[i] = "id"
    for i in marked:
        w = named[i]
        if i + 1 == len(out):
            continue
        before, after = out[i - 1] if i else "nl", out[i + 1]
        if after not in words[w] or before in (".", "?."):
            continue
        if lang == "py":
            # A statement that starts with the word and, but for type, ends in a colon.
            if before not in ("nl", "indent", "dedent", "^"):
                continue
            if w != "type" and not _colon(out, i + 1):
                continue
        if w == "of" and before not in ("id", "]", "}"):
            continue
        if w == "async" and after == "(":
            depth, j = 0, i + 1
            while j < len(out):
                depth += (out[j] == "(") - (out[j] == ")")
                j += 1
                if not depth:
                    break
            if j >= len(out) or out[j] not in ("=>", "{"):
                continue
        if w in ("let", "record", "permits", "sealed") and before == "id":
            if w != "permits":
                continue
        out[i] = w


def _colon(out: list[str], start: int) -> bool:
    """Whether a colon stands outside brackets before the line's end."""
    depth = 0
    for j in range(start, len(out)):
        k = out[j]
        if k == "nl":
            return False
        depth += (k in ("(", "[", "{")) - (k in (")", "]", "}"))
        if k == ":" and not depth:
            return True
    return False


def lex(text: str, lang: str, comments: bool = False) -> list[Token]:
    """``(kind, first offset, last offset)`` of all tokens; see ``scan``."""
    return scan(text, lang, comments).tokens()
