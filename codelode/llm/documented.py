"""Functions paired with their documentation, by packrat grammars over tokens with offsets."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, functions as F

from codelode.llm.informative import clean_block, clean_docstring, informative
from codelode.llm.lexing import OPEN, Lexed, scan
from codelode.llm.peg import Grammar, partners
from codelode.session import cut_lineage

PYTHON = r"""
File = Item*
Item = Class | Func | Stmt
Class = Decor* class Name Group* ':' Suite
Func = Decor* async? def Name Square? Params ('->' (Group | !':' !nl .)+)? ':' Body
Decor = '@' (Group | !nl .)* nl
Suite = nl indent Doc? (Item | nl)* dedent | OneLine
Body = nl %(indent Doc)? ^indent | OneLine
OneLine = Doc? Rest
Rest = (Group | !nl .)* nl
Doc = str+ &(nl | ';')
Stmt = nl | !dedent !indent (Group | !nl !dedent .)+ (nl (indent Item* dedent)?)? | indent Item* dedent
Name = id
Params = Round
Group = Round | Square | Curly
Round = ^'('
Square = ^'['
Curly = ^'{'
"""

JAVA = r"""
File = (Type | Group | .)*
Type = Doc? Mod* (class | interface | enum | record | '@' interface) Name TypeHead '{' Constants? Member* '}'
TypeHead = (Round | !'{' !';' .)*
Constants = (Doc | Mod | id Round? Curly? ','?)* ';'
Member = Type | Func | Curly | Field
Func = Doc? Mod* Angle? (Return Name | Name) Params ('[' ']')* (throws (!'{' !';' .)+)? (default (!';' .)*)? (Curly | ';')
Field = Doc? (Group | !'}' !doc !';' .)+ ';'? | Doc
Return = (void | One) ('[' ']')*
One = Prim | id Angle? ('.' id Angle?)*
Prim = boolean | byte | char | short | int | long | float | double
Mod = '@' !interface id ('.' id)* Round? | public | protected | private | static | abstract | final | native | synchronized | transient | volatile | strictfp | default | sealed
Angle = '<' (Angle | !'>' !'(' !'{' !';' .)* '>'
Name = id &('(' | '{' | '<' | extends | implements | permits | id)
Params = Round
Doc = doc
Group = Round | Square | Curly
Round = ^'('
Square = ^'['
Curly = ^'{'
"""

JS = r"""
File = (Class | Func | Bound | Group | .)*
Class = Doc* (export default?)? (Bind? class Name? Heritage? '{' Member* '}')
Heritage = extends (Round | !'{' .)+
Member = Func1 | Doc | Field
Func1 = Doc* Method
Method = Word* '*'? Key Params Curly
Word = (id | async) &(Key | async | '*')
Field = (Group | !'}' !doc !';' !nl .)+ (';' | nl)? | ';' | nl
Func = Doc (export default?)? async? function '*'? Name Params Curly | (export default?)? async? function '*'? Name Params Curly
Bound = Doc Bind async? (function '*'? id? Params Curly | (Params | id) '=>' (Curly | .))
Bind = (const | let | var) Name '=' | Path '='
Path = (this | id) ('.' id)* '.' Name
Key = Name | str | num | Square
Name = id
Params = Round
Doc = doc
Group = Round | Square | Curly
Round = ^'('
Square = ^'['
Curly = ^'{'
"""

GO = r"""
File = (Func | Group | .)*
Func = Doc? func Receiver? Name Square? Params Result? Curly?
Receiver = Round
Result = Round &('{' | ';') | (Group | !'{' !';' .)+
Name = id
Params = Round
Doc = doc
Group = Round | Square | Curly
Round = ^'('
Square = ^'['
Curly = ^'{'
"""

TEXTS = {"py": PYTHON, "java": JAVA, "js": JS, "go": GO}
KEEP = frozenset(["Class", "Type", "Func", "Func1", "Method", "Bound", "Name", "Params", "Doc", "Receiver"])


@cache
def grammar(lang: str) -> Grammar:
    return Grammar(TEXTS[lang])


Pair = tuple[str, str, str, str, str, int, int]  # name, qualified name, class, signature, documentation, first and last offset


def _documented_tokens(read: Lexed, text: str, lang: str) -> tuple[list[str], list[int]]:
    """Kinds, with documentation comments as ``doc`` and other comments left out, and their places in ``read``.

    A documentation comment of several lines in Go stands at its first line.
    """
    kinds, places = read.kinds, range(len(read.kinds))
    if lang == "py" or "comment" not in kinds:
        return kinds, list(places)
    out: list[str] = []
    at: list[int] = []
    held: list[int] = []  # first and last line of the comment right above
    for i, kind in enumerate(kinds):
        if kind != "comment":
            if held:
                # Lines right above the function, nothing between.
                if kind == "func" and text.count("\n", read.span(held[1])[1], read.span(i)[0]) == 1:
                    out.append("doc")
                    at.append(held[0])
                if kind != ";" or read.at[i] >= 0:
                    held = []
            if kind == "nl" and out and out[-1] == "doc":
                out.insert(-1, kind)  # the line break belongs to what stands before the comment
                at.insert(-1, i)
            else:
                out.append(kind)
                at.append(i)
            continue
        a, b = read.span(i)
        if lang == "go":
            own_line = not text[text.rfind("\n", 0, a) + 1 : a].strip()
            if text.startswith("//", a) and own_line:
                follows = held and text.count("\n", read.span(held[1])[1], a) == 1
                held = [held[0], i] if follows else [i, i]
            else:
                held = []
        elif text.startswith("/**", a) and b - a > 4:
            if out and out[-1] == "doc":
                out.pop()  # only the nearest block counts
                at.pop()
            out.append("doc")
            at.append(i)
    return out, at


def _block(read: Lexed, i: int) -> str:
    """A documentation comment from its first line on."""
    a, b = read.span(i)
    text = read.text(i)
    j = i
    while j + 1 < len(read.kinds) and (read.kinds[j + 1] == "comment" or read.kinds[j + 1] == ";" and read.at[j + 1] < 0) and text.startswith("//"):
        j += 1
        if read.kinds[j] == "comment":
            text += "\n" + read.text(j)
    return text


def functions(text: str, lang: str, read: Lexed | None = None) -> list[Pair]:
    """Functions and methods of a source text with their documentation, outermost level and classes."""
    read = scan(text, lang, comments=lang != "py") if read is None else read
    kinds, at = _documented_tokens(read, text, lang)
    nodes = grammar(lang).tree("File", kinds, KEEP, partners(kinds, OPEN))
    found: list[Pair] = []

    def span(node: tuple) -> tuple[int, int]:
        a, b = node[1], node[2]
        return read.span(at[a])[0], read.span(at[max(a, b - 1)])[1]

    def body(node: tuple) -> str:
        a, b = span(node)
        return text[a:b]

    def walk(node: tuple, classes: tuple[str, ...]) -> None:
        name, _, _, inner = node
        own = {}
        for x in inner:
            if x[0] not in own or x[0] == "Doc" and lang != "py":
                own[x[0]] = x
        label = body(own["Name"]).strip("\"'") if "Name" in own else ""
        if name in ("Class", "Type"):
            for x in inner:
                if x[0] in ("Class", "Type", "Func", "Func1", "Method", "Bound"):
                    walk(x, (*classes, label) if label else classes)
            return
        if name == "Func1":
            doc = next((x for x in reversed(inner) if x[0] == "Doc"), None)
            for x in inner:
                if x[0] == "Method":
                    walk(("Method", x[1], x[2], [*([doc] if doc else []), *x[3]]), classes)
            return
        if not label or "Params" not in own:
            return
        if "Receiver" in own:
            ids = re.findall(r"[^\W\d]\w*", re.sub(r"\[.*\]", "", body(own["Receiver"]), flags=re.S))
            classes = (ids[-1],) if ids else ()
        a, b = span(node)
        doc = ""
        if "Doc" in own:
            doc = clean_docstring(body(own["Doc"])) if lang == "py" else clean_block(_block(read, at[own["Doc"][1]]) if lang == "go" else body(own["Doc"]))
        head = read.span(at[own["Doc"][2]])[0] if "Doc" in own and lang != "py" else a
        sig = " ".join(text[head : span(own["Params"])[1]].split())
        found.append((label, ".".join((*classes, label)), ".".join(classes), sig, doc, a, b))

    for node in nodes or ():
        walk(node, ())
    return found


def argument_names(sig: str) -> list[str]:
    """All words of a signature; types and parameter names alike say nothing new in a description."""
    return re.findall(r"[^\W\d]\w*", sig)


#: Fields of a function: what finding it needs, or all.
PAIR_FIELDS = {
    "found": "qualified_name: string, informative: boolean",
    "pairs": "name: string, qualified_name: string, class_name: string, signature: string, docstring: string, informative: boolean, start_line: int, end_line: int, code: string",
}


def pair_rows(text: str, lang: str, read: Lexed, whole: bool) -> list[dict]:
    """The functions of a lexed text, with the fields of PAIR_FIELDS."""
    out = []
    line, at = 1, 0
    for name, qualified, cls, sig, doc, a, b in functions(text, lang, read):
        useful = informative(doc, qualified, argument_names(sig))
        if not whole:
            out.append({"qualified_name": qualified, "informative": useful})
            continue
        if a < at:
            line, at = 1, 0
        line, at = line + text.count("\n", at, a), a
        out.append({"name": name, "qualified_name": qualified, "class_name": cls, "signature": sig, "docstring": doc, "informative": useful, "start_line": line, "end_line": line + text.count("\n", a, b), "code": text[a:b]})
    return out


def documented_functions(files: DataFrame, sound_only: bool = True, fields: str = "pairs") -> DataFrame:
    """``(path, repo, language, <PAIR_FIELDS>)`` of all functions and methods; ``informative`` says whether the documentation is useful.

    Files are read once: the tokens that find the functions also tell whether the file parses. Files that
    do not are left out, unless ``sound_only`` is false. Null contents and other suffixes
    give no rows; repeated deliveries count once. Functions inside functions do not count.
    """
    from codelode.llm.syntax import judged, lexed, small

    read = lexed(files, fields)
    rows = read.where(F.size("functions") > 0)
    if sound_only:
        rows = rows.join(small(cut_lineage(judged(files, read).select("path"))), "path", "left_anti")
    rows = rows.select("path", "repo", F.col("lang").alias("language"), F.inline("functions"))
    if fields == "found":
        return rows.distinct()
    once = ["path", "qualified_name", "start_line", "__hash"]
    return rows.withColumn("__hash", F.xxhash64("signature", "docstring", "code")).dropDuplicates(once).drop("__hash")


def useful_pairs(files: DataFrame) -> DataFrame:
    """Description-code pairs; of overloads, those that are documented."""
    return documented_functions(files).where("informative")


def p2_found(files: DataFrame) -> DataFrame:
    """Functions and methods with useful documentation."""
    return documented_functions(files, fields="found").where("informative").select("path", "qualified_name").distinct()
