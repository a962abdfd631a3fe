"""Grammars of the contents of brackets and blocks, one level at a time.

Nested groups are single tokens here: ``()`` an empty one, ``(.)`` one with contents, likewise for
square brackets and braces, and ``<>`` an indented block of Python. The first token of a
sequence names its place: ``file``, or the opening bracket after the kind that stands before it.
"""

from __future__ import annotations

from functools import cache

from codelode.llm.peg import Grammar

PYTHON = r"""
Start = 'file' nl* Stmt* | 'block' Stmt+ | 'def(' Params? | 'call(' Args? | '(' (YieldE !. | Args !. | StarList !. | WithItem (',' WithItem)* ','? !.)? | 'call[' Slices | '[' (StarNamed (CompFor | (',' StarNamed)* ','?))? | '{' (Items)?
Suite = Line | nl '<>'
Line = Simple (';' Simple)* ';'? nl
Stmt = Compound | Line
Compound = ('@' Named nl)* (async? def id '[.]'? Paren ('->' Expr)? ':' Suite | class id '[.]'? Paren? ':' Suite) | if Named ':' Suite (elif Named ':' Suite)* Else? | while Named ':' Suite Else? | async? for Targets in StarList ':' Suite Else? | Try | async? with WithItem (',' WithItem)* ','? ':' Suite | match StarList ':' nl '<>' | case Pattern (if Named)? ':' Suite
Else = else ':' Suite
Try = try ':' Suite (Except+ Else? (finally ':' Suite)? | finally ':' Suite)
Except = except ('*'? Expr (as id | (',' Expr)+)?)? ':' Suite
WithItem = Expr (as Target)?
Pattern = StarPat (',' StarPat)* ','?
StarPat = '*' id | OrPat (as id)?
OrPat = ('-'? Post | Post) ('|' ('-'? Post))* (('+' | '-') num)?
Simple = type id '[.]'? '=' Expr | Assign | return StarList? | raise (Expr (from Expr)?)? | pass | break | continue | import Dotted (as id)? (',' Dotted (as id)?)* | From | global id (',' id)* | nonlocal id (',' id)* | del Targets | assert Expr (',' Expr)? | YieldE | StarList
From = from ('.' | '...')* Dotted import ('*' | '(.)' | ImportAs (',' ImportAs)*) | from ('.' | '...')+ import ('*' | '(.)' | ImportAs (',' ImportAs)*)
ImportAs = id (as id)?
Dotted = id ('.' id)*
Assign = Target ':' Expr ('=' (YieldE | StarList))? | Target AugOp (YieldE | StarList) | (Targets '=')+ (YieldE | StarList) !'='
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Targets = Target (',' Target)* ','?
Target = '*'? (id | Paren | '[.]' | '[]' | str+ &'.' | '{.}' &'[.]') (Paren* ('.' id | '[.]'))*
YieldE = yield (from Expr | StarList)?
StarList = StarNamed (',' StarNamed)* ','?
StarNamed = '*' Expr | Named
Named = id ':=' Expr | Expr
Expr = lambda LParams? ':' Expr | Disj (if Disj else Expr)?
Disj = Un (BinOp Un)*
BinOp = or | and | not in | in | is not | is | '<' | '>' | '==' | '>=' | '<=' | '!=' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '|' | '&' | '^' | '<<' | '>>'
Un = (not | '+' | '-' | '~' | await)* Post
Post = Prim ('.' id | Paren | '[.]')*
Prim = id | num | str+ | 'None' | 'True' | 'False' | '...' | Paren | '[]' | '[.]' | '{}' | '{.}'
Paren = '()' | '(.)'
LParams = LParam (',' LParam)* ','?
LParam = '*' id? | '**' id | '/' | id ('=' Expr)?
Params = (Plain (',' Plain)* (',' Given)* | Given (',' Given)*) (',' Rest)? ','? | Rest ','?
Plain = ('/' | id (':' Expr)? !'=') &(',' | !.)
Given = ('/' | id (':' Expr)? '=' Expr) &(',' | !.)
Rest = '*' (id (':' StarNamed)?)? (',' Only)* (',' Twice)? | Twice
Only = id (':' Expr)? ('=' Expr)?
Twice = '**' id (':' Expr)?
Args = (Front (',' Front)* (',' Back)* | Back (',' Back)*) (',' Last)* ','? | Last (',' Last)* ','?
Front = ('*' Expr | Named CompFor? | id as id) &(',' | !.)
Back = (id '=' Expr | '*' Expr) &(',' | !.)
Last = '**' Expr | id '=' Expr
CompFor = async? for Targets in Disj (if Disj)* CompFor?
Slices = Slice (',' Slice)* ','?
Slice = Expr? ':' Expr? (':' Expr?)? | StarNamed
Items = Item (',' Item)* ','? | Item CompFor
Item = '**' Expr | StarNamed (':' Expr)?
"""

JAVA = r"""
Start = 'file' File | 'if(' Expr | 'while(' Expr | 'switch(' Expr | 'synchronized(' Expr | 'for(' ForHead | 'catch(' Mods Type ('|' Type)* id | 'try(' Resource (';' Resource)* ';'? | '(' (Args | Params | Type ('&' Type)* !. | AnnArgs !. | Patterns !.)? !. | '[' Expr? | '{' Braces | 'init{' ArrayInit? !. | 'block{' Block | 'class{' ClassBody | 'enum{' EnumBody | 'switch{' SwitchBody
Braces = ClassBody !. | Block !. | SwitchBody !. | EnumBody !. | ArrayInit !.
File = (Ann* package Name ';')? (import static? Name ('.' '*')? ';' | ';')* TypeDecl*
TypeDecl = ';' | Mods TypeRest
TypeRest = class id TypeParams? (extends Type)? (implements TypeList)? (permits TypeList)? Body | interface id TypeParams? (extends TypeList)? (permits TypeList)? Body | enum id (implements TypeList)? Body | record id TypeParams? Paren (implements TypeList)? Body | '@' interface id Body
Mods = (Ann | public | protected | private | static | abstract | final | native | synchronized | transient | volatile | strictfp | default | sealed)*
Ann = '@' !interface Name Paren?
Name = id ('.' id)*
Type = (Ann* Prim | Ann* ClassType) (Ann* '[]')*
Prim = boolean | byte | char | short | int | long | float | double
ClassType = id TypeArgs? ('.' Ann* id TypeArgs?)*
TypeList = Type (',' Type)*
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg = Ann* '?' ((extends | super) Type)? | Type
TypeParams = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Ann* id (extends Type ('&' Type)*)?
Body = '{}' | '{.}'
Paren = '()' | '(.)'
ClassBody = Member*
Member = ';' | static? Body | Mods (TypeRest | Method | Ctor | Type Vars ';')
Method = TypeParams? (void | Type) id Paren '[]'* (throws TypeList)? (Body | (default Element)? ';')
Ctor = TypeParams? id Paren? (throws TypeList)? Body
Vars = Var (',' Var)*
Var = id '[]'* ('=' Init)?
Init = Body | Expr
Block = Stmt*
Stmt = Body | ';' | Mods TypeRest | Mods Type Vars ';' | if '(.)' Stmt (else Stmt)? | while '(.)' Stmt | do Stmt while '(.)' ';' | for '(.)' Stmt | switch '(.)' Body | Try | return Expr? ';' | throw Expr ';' | break id? ';' | continue id? ';' | synchronized '(.)' Body | assert Expr (':' Expr)? ';' | yield Expr ';' | id ':' Stmt | ExprStmt ';'
ExprStmt = Target AssignOp Expr | ('++' | '--') Unary | Primary (Other* Paren)+ Other* ('++' | '--') | Primary (Other* Paren)+ | Primary Other* ('++' | '--') | new Creator
Other = !Paren Suffix
Target = Primary (Paren* Tail)+ &AssignOp | id &AssignOp | '(.)' &AssignOp
Tail = '.' TypeArgs? (id | this) | '[.]'
Try = try '(.)' Body Catch* (finally Body)? | try Body (Catch+ (finally Body)? | finally Body)
Catch = catch '(.)' Body
SwitchBody = (Label ('->' (Body | throw Expr ';' | Expr ';') | ':' Stmt*))*
Label = case CaseItem (',' CaseItem)* | default
CaseItem = (Mods Type id | Type '(.)' id? | CaseAtom (BinOp CaseAtom)*) (id Expr)?
CaseAtom = default | '-'? num | str | null | true | false | Name | Paren
EnumBody = (EnumConst (',' EnumConst)* ','?)? (';' ClassBody)?
EnumConst = Ann* id Paren? Body?
ArrayInit = Init (',' Init)* ','? | ','
Patterns = Pattern (',' Pattern)*
Pattern = Mods Type id | Type '(.)' id?
ForHead = Mods Type id ':' Expr | (Mods Type Vars | ExprList)? ';' Expr? ';' ExprList?
ExprList = Expr (',' Expr)*
Resource = Mods Type id '=' Expr | Expr
Args = Expr (',' Expr)* !.
Params = Param (',' Param)* !.
Param = Mods Type (Ann* '...')? (id '.')? (id | this) '[]'*
AnnArgs = AnnArg (',' AnnArg)* | Element
AnnArg = id '=' Element
Element = Body | Ann | Expr
Expr = Lambda | Target AssignOp Expr | Ternary
Lambda = (id | Paren) '->' (Body | Expr)
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '>=' | '>' '>='
Ternary = Bin ('?' Expr ':' (Lambda | Ternary))?
Bin = Unary (BinOp Unary | instanceof Mods Type ('(.)' | id)?)*
BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<=' | '>=' | '<<' | '<' | '>' '>' '>' | '>' '>' | '>' | '+' | '-' | '*' | '/' | '%'
Unary = ('+' | '-' | '++' | '--' | '!' | '~')* (Cast | Postfix)
Cast = '(.)' &(id | num | str | Paren | this | new | super | '!' | '~' | true | false | null | switch | Prim) (Lambda | Unary)
Postfix = Primary Suffix* ('++' | '--')?
Primary = num | str | true | false | null | this | super | Paren | id | new Creator | Prim '[]'* ('.' class | '::' new) | void '.' class | switch '(.)' Body
Suffix = '.' TypeArgs? (id | this | class | super | new Creator) | Paren | '[.]' | '::' TypeArgs? (id | new) | '[]'+ ('.' class | '::' new) | TypeArgs '[]'* '::' (id | new)
Creator = TypeArgs? Ann* (Prim | ClassType) ('[.]'+ '[]'* | '[]'+ Body | Paren Body?)
"""

JS = r"""
Start = 'file' Stmt* | 'if(' Expr | 'while(' Expr | 'switch(' Expr | 'with(' Expr | 'for(' ForHead | 'await(' (ForHead !. | Elems !.) | 'catch(' (id | Array | Body) | '(' (Elems | Expr)? !. | 'call[' Expr | '[' Elems? | 'block{' Stmt* | 'class{' ClassBody | 'switch{' SwitchBody | '{' Braces
Braces = Stmt* !. | ObjLit? !.
E = ';' | nl | !. | &else
Stmt = ';' | nl | Body | (var | let) Binding (',' Binding)* E | const Bound (',' Bound)* E | async? function '*'? id Paren Body | class id (extends Postfix)? Body | if '(.)' nl? Stmt (nl? else nl? Stmt)? | for await? '(.)' nl? Stmt | while '(.)' nl? Stmt | do nl? Stmt while '(.)' ';'? | switch '(.)' Body | try Body (catch '(.)'? Body (finally Body)? | finally Body) | return Expr? E | throw Expr E | (break | continue) id? E | debugger E | with '(.)' nl? Stmt | id ':' nl? Stmt | !function !class Expr E
Body = '{}' | '{.}'
Paren = '()' | '(.)'
Array = '[]' | '[.]'
Binding = id ('=' Assign)? | Bound
Bound = (id | Array | Body) '=' Assign
ForHead = (var | const | let) (id | Array | Body) (in | of) Expr !. | Postfix (in | of) Expr !. | ((var | let) Binding (',' Binding)* | const Bound (',' Bound)* | Expr)? ';' Expr? ';' Expr?
Expr = Assign (',' Assign)*
Assign = Arrow | yield '*'? Assign? | Place AssignOp Assign | Cond
Place = new* Primary (Call* Tail)+ &AssignOp | (id | Array | Body | '(.)') &AssignOp | (of | async | let) &AssignOp
Call = Paren | tpl
Tail = '.' '#'? id | '[.]'
Arrow = (async? (id | Paren) | id Paren) '=>' (Body | Assign)
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Cond = Bin ('?' Assign ':' Assign)?
Bin = Unary (BinOp Unary)*
BinOp = '||' | '&&' | '??' | '|' | '^' | '&' | '===' | '!==' | '==' | '!=' | '<=' | '>=' | '<' | '>' | in | instanceof | '<<' | '>>>' | '>>' | '+' | '-' | '**' | '*' | '/' | '%'
Unary = (delete | void | typeof | '+' | '-' | '~' | '!' | '++' | '--' | await | new)* Postfix
Postfix = Primary ('.' '#'? id | '?.' (id | Paren | '[.]') | Paren | '[.]' | tpl)* ('++' | '--')?
Primary = num | str | tpl | id | this | super | null | true | false | '(.)' | Array | Body | async? function '*'? id? Paren Body | class id? (extends Postfix)? Body | import Paren | '#' id | new '.' id
Elems = (Elem | ',')* 
Elem = '...'? Assign &(',' | !.)
Key = id | str | num | '[.]' | '#' id | Word
Word = break | case | catch | class | const | continue | debugger | default | delete | do | else | export | extends | finally | for | function | if | import | in | instanceof | new | return | super | switch | this | throw | try | typeof | var | void | while | with | null | true | false | async | of | let | await | yield
ObjLit = Prop (',' Prop)* ','?
Prop = '...' Assign | Key ':' Assign | ((async | id) &(Key | '*'))? '*'? Key Paren Body | id ('=' Assign)? | of | async | let
ClassBody = (';' | nl | Element)*
Element = ((id | async) &(Key | '*'))* '*'? Key Paren Body | id Body | (id &Key)? Key ('=' Assign)? (';' | nl | !.)
SwitchBody = nl* ((case Expr | default) ':' Stmt*)*
"""

GO = r"""
Start = 'file' File | '(' (Params | Args | Group | type | Result0) !. | '(' | '[' ('...' | Index) !. | '[' | 'block{' Block | 'struct{' StructBody | 'interface{' InterfaceBody | 'switch{' SwitchBody | 'lit{' LitBody? | '{' Braces
Braces = Block !. | LitBody? !.
File = package id ';' (import (ImportSpec | Paren) ';')* (Top ';')* Top?
Top = func Paren? id '[.]'? Paren Result? Body? | Decl
ImportSpec = (id | '.')? str
Group = Spec (';' Spec)* ';'?
Spec = ImportSpec | Ids Type? '=' Exprs | Ids Type | Ids | id '[.]'? '='? Type
Decl = (var | const | type) Paren | var (Ids (Type? '=' Exprs | Type)) | const Ids (Type? '=' Exprs)? | type id '[.]'? '='? Type
Ids = id (',' id)*
Body = '{}' | '{.}'
Paren = '()' | '(.)'
Result = Type | Paren
Result0 = Type (',' Type)* ','?
Type = '*' Type | '[]' Type | '[.]' Type | map '[.]' Type | '<-' chan Type | chan '<-'? Type | func Paren Result? | struct Body | interface Body | id ('.' id)? '[.]'? | Paren
Block = (Stmt? ';')* Stmt?
Stmt = Decl | If | For | Switch | select Body | return Exprs? | break id? | continue id? | goto id | fallthrough | go Expr | defer Expr | Body | id ':' Stmt? | Simple
Simple = Ids ':=' (range Expr | Exprs) | Exprs AssignOp (range Expr | Exprs) | Expr '<-' Expr | Expr ('++' | '--')? !(',' | ':=' | '=')
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
SimpleN = Ids ':=' (range ExprN | ExprsN) | ExprsN AssignOp (range ExprN | ExprsN) | ExprN '<-' ExprN | ExprN ('++' | '--')?
If = if (SimpleN? 'head;')? ExprN Body (else (If | Body))?
For = for (Body | range ExprN Body | SimpleN? 'head;' ExprN? 'head;' SimpleN? Body | (Ids ':=' | ExprsN '=') range ExprN Body | ExprN Body)
Switch = switch (SimpleN? 'head;')? SimpleN? Body
Exprs = Expr (',' Expr)*
ExprsN = ExprN (',' ExprN)*
Expr = Un (BinOp Un)*
ExprN = UnN (BinOp UnN)*
BinOp = '||' | '&&' | '==' | '!=' | '<=' | '>=' | '<' | '>' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&^' | '&'
Op = '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~'
Un = Op* Prim Suf*
UnN = Op* Prim SufN*
Suf = SufN | Body
SufN = '.' id | '.' '(.)' | Paren | '[.]'
Prim = num | str | func Paren Result? Body | '[]' Type (Body | Paren) | '[.]' Type (Body | Paren)? | map '[.]' Type (Body | Paren)? | struct Body Body | chan Type | interface Body | id | '(.)'
Args = Arg (',' Arg)* ','?
Arg = (Expr '...'? | Type) &(',' | !.)
Params = Param (',' Param)* ','?
Param = id '...'? Type &(',' | !.) | '...'? Type &(',' | !.)
Index = Expr? ':' Expr? (':' Expr)? | (Expr | Type) (',' (Expr | Type))* ','? !. | Ids Constraint (',' Ids Constraint)* ','?
Constraint = '~'? Type ('|' '~'? Type)*
StructBody = ((Ids Type | '*'? id ('.' id)?) str? ';')* ((Ids Type | '*'? id ('.' id)?) str?)?
InterfaceBody = ((id Paren Result? | Constraint) ';')* (id Paren Result? | Constraint)?
LitBody = LitEl (',' LitEl)* ','?
LitEl = LitVal (':' LitVal)?
LitVal = Body | Expr
SwitchBody = ((case (Simple !',' | (Expr | Type) (',' (Expr | Type))*) | default) ':' Block)*
"""

JSON = r"""
Start = 'file' Value | '[' (Value (',' Value)*)? | '{' (str ':' Value (',' str ':' Value)*)?
Value = str | num | true | false | null | '{}' | '{.}' | '[]' | '[.]'
"""

TEXTS = {"py": PYTHON, "java": JAVA, "js": JS, "go": GO, "json": JSON}


@cache
def grammar(lang: str) -> Grammar:
    return Grammar(TEXTS[lang])


def accepts(lang: str, kinds: list[str]) -> bool:
    """Whether one level of a file is as the grammar says."""
    return grammar(lang).accepts("Start", kinds)


@cache
def neighbours(lang: str) -> frozenset[tuple[str, str]]:
    """Pairs of kinds that may follow each other in a token stream, groups written out.

    Derived from the grammar: a group's token stands for its opening bracket on the right and its
    closing one on the left, and what may begin or end its contents comes from Start.
    """
    g = grammar(lang)
    groups = {"()": "()", "(.)": "()", "[]": "[]", "[.]": "[]", "{}": "{}", "{.}": "{}"}
    block = {"<>": ("indent", "dedent")}

    def left(k: str) -> str:  # how a token ends
        return block[k][1] if k in block else groups[k][1] if k in groups else k.removeprefix("head")

    def right(k: str) -> str:  # how a token begins
        return block[k][0] if k in block else groups[k][0] if k in groups else k.removeprefix("head")

    places = {"file": "^", "block": "indent"}
    out: set[tuple[str, str]] = set()
    for a, b in g.pairs():
        if a in ("file", "block") or a[-1:] in "([{" and a not in ("(", "[", "{") and a[:-1].isalpha():
            a2 = places.get(a, a[-1:])
        else:
            a2 = left(a)
        out.add((a2, right(b)))
    lasts = g._edges(False)
    start = g.rules["Start"]
    for option in start[1:] if start[0] == "alt" else [start]:
        place = option[1][1] if option[0] == "seq" else option[1]
        close = {"file": "$", "block": "dedent"}.get(place) or {"(": ")", "[": "]", "{": "}"}[place[-1]]
        open_ = places.get(place, place[-1])
        body = ("seq", *option[2:]) if option[0] == "seq" else None
        if body:
            out.update((left(k), close) for k in g._edge(body, lasts, False))
        if body is None or all(g._empty(x, g._null) for x in option[2:]):
            out.add((open_, close))
    out |= {("(", ")"), ("[", "]"), ("{", "}"), ("^", "$")}
    if lang in ("js", "py"):
        out |= {(a, "nl") for a, b in out if b in ("$", "}", "dedent")} if lang == "js" else set()
    return frozenset(out)
