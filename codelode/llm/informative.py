"""Whether documentation says more than names do."""

from __future__ import annotations

import ast
import re


def clean_docstring(literal: str) -> str:
    """The text of a Python docstring literal; bytes and f-strings are none."""
    try:
        v = ast.literal_eval(literal if "\n" not in literal else f"({literal})")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return ""
    return v.strip() if isinstance(v, str) else ""


def clean_block(comment: str) -> str:
    """A block or line comment without its marks."""
    if comment.startswith("/*"):
        lines = comment[3:-2].split("\n")
        return "\n".join(re.sub(r"^\s*\*? ?", "", x).rstrip() for x in lines).strip()
    return "\n".join(re.sub(r"^\s*//+ ?", "", x).rstrip() for x in comment.split("\n")).strip()


# Words that describe nothing by themselves in a comment on a function.
FILLER = frozenset(
    """
    a an and any are arg args argument arguments as at auto autogenerated be been below by callable class code comment comments constructor
    default def describe description desc details doc docs docstring document documentation does element example examples fill fixme follow following
    follows for foo from func function functions given generated go goes has have helper here i if implementation in init inherit inheritdoc
    into is it its keyword kwargs later literal little lorem ipsum method methods misc missing n name named na no nil none nothing note null object of on one or
    overrides override param parameter parameters params placeholder please proper provide real replace required result return returned returning returns
    rtype see self should simple some something stub subroutine such summary tbd tba tbc text that the their then there these this those throws to todo type
    typing undocumented unknown use used uses using utility value values various void want was wip with write xxx xx yield yields you your available add
    above short long brief hack function's e g eg ie etc raises raise exception exceptions operation itself do instance also link same
    """.split()
)
_POINTER = re.compile(r"^\W*(?:see\b|refer\b|cf\b|as above|same as (?:above|below|in)\b|\{?@(?:inheritdoc|see|link)|inherited\b|overrides?\b|(?:documented|described|explained)\s+(?:in|at|elsewhere|above|below)\b|for (?:details|more)\b)", re.I)
_OPEN = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack)\b", re.I)
_MISSING = re.compile(r"\b(?:no|missing|add|replace|proper|without|lacks?|needs?|write|insert|put)\b[^.]{0,60}\b(?:description|documentation|docstring|docs?|comment|text)\b|\b(?:description|documentation|docstring)\b[^.]{0,40}\b(?:missing|goes here|here|pending|to follow|available)\b|\bauto-?generated\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n|\n(?=\s*(?:[@:]\w|[-*] |\w+\s*\([^)]*\)\s*:|\w+\s*:))")
_HEAD = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields|notes?|examples?|attributes|usage)\s*:?\s*$", re.I | re.M)
_RULE = re.compile(r"^\s*[-=~*_#.]{2,}\s*$", re.M)
_TYPE = re.compile(r"\{[^{}]*\}|\([^()]*\)(?=\s*:)|(?<=:)\s*(?:int|str|bool|float|list|dict|object|string|number|boolean|array|any|optional)\b", re.I)
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")


def stem(word: str) -> str:
    """A word without the endings that names and sentences vary."""
    w = word.lower()
    for end in ("ings", "ing", "ies", "ied", "es", "ed", "ers", "er", "ors", "or", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] in "ey" else w


def names_in(text: str) -> set[str]:
    """Stems of the parts of all names in a text."""
    return {stem(x) for x in _PART.findall(text)}


_FILLED = frozenset(stem(x) for x in FILLER) | FILLER


def new_words(doc: str, qualified: str, arguments: list[str]) -> list[str]:
    """Words of a documentation that neither its names nor filler account for."""
    known = names_in(qualified + " " + " ".join(arguments))
    whole = {x.lower() for x in [*qualified.split("."), *arguments]}
    text = _RULE.sub("", _HEAD.sub("", doc))
    out: list[str] = []
    for part in _SENTENCE.split(text):
        if _POINTER.match(part) or _OPEN.match(part) or _MISSING.search(part):
            continue
        part = _TYPE.sub(" ", part)
        for w in re.findall(r"[^\W\d_][\w'’]*", part):
            low = w.lower()
            if low in whole or low in FILLER:
                continue
            pieces = [stem(x) for x in _PART.findall(w)]
            if pieces and all(x in known or x in _FILLED for x in pieces):
                continue
            out.append(low)
    return out


def informative(doc: str, qualified: str, arguments: list[str]) -> bool:
    """Whether a documentation says anything about behaviour, units, limits or failure beyond the names.

    Sentences that point elsewhere, announce a later description or say that one is missing are
    passed over; so are headings, rules, types and tags without words. One new word is enough:
    "Not reentrant." says more than its name. Null and blank texts say nothing.
    """
    return bool(doc) and bool(new_words(doc, qualified, arguments))
