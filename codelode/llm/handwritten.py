"""Generated, minified, vendored and data files among sources: declarations and mined equivalents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode.llm.lexing import LANGUAGES, Lexed, scan
from codelode.session import cut_lineage

CODE = (".py", ".java", ".js", ".go")


@dataclass(frozen=True)
class MiningParams:
    copy_tokens: int = 20  # least tokens of a file whose copies in two repositories make it a vendored one
    stem_share: float = 0.5  # of the files of a library's name that are known as vendored
    dir_share: float = 0.9  # of the files below a directory name that are known as vendored
    dir_repos: int = 3
    name_share: float = 0.9  # of the files of a name pattern that are known as not hand-written
    name_repos: int = 2
    odds: float = 1.0  # mean log odds of a file's line shapes under declared files against the rest
    least_shapes: int = 2
    blank_share: float = 0.06  # minified text has less white space than this ...
    long_line: int = 250  # ... and a line longer than this
    data_words: int = 12  # most different names and keywords, keys left out, in a file that only holds data


# Attribute files.


def parse_attributes(path: str, text: str) -> list[tuple[str, str, str, bool]]:
    """``(directory, pattern, attribute, value)`` of the lines of an attribute file that mark files.

    Both ``linguist-generated`` and ``linguist-vendored`` are read, set, unset (``-x``, ``x=false``)
    or given as ``x=true``. Comments, quoted patterns and macros that set nothing else are passed over.
    """
    base = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#[" or line[0] == "!":
            continue
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s+(.*)', line)
        pattern, rest = (m[1].replace('\\"', '"'), m[2]) if m else (line.split(None, 1) + [""])[:2]
        for a in rest.split():
            name, _, value = a.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored"):
                out.append((base, pattern, name.removeprefix("linguist-"), a[0] not in "-!" and value.lower() not in ("false", "0")))
    return out


@lru_cache(maxsize=4096)
def glob_regex(pattern: str) -> re.Pattern[str]:
    """An attribute pattern as a regular expression over the path below the attribute file."""
    anchored = "/" in pattern.rstrip("/")
    p = pattern.strip("/") if pattern.startswith("/") else pattern.rstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + ("/.*" if pattern.endswith("/") else ""))


def resolve(path: str, rules: list[tuple[str, str, str, bool]]) -> dict[str, bool]:
    """What rules say about a path: deeper attribute files win, then later lines."""
    said: dict[str, bool] = {}
    for base, pattern, name, value in sorted(rules, key=lambda r: r[0].count("/")):  # stable: lines keep their order
        if path.startswith(base) and glob_regex(pattern).fullmatch(path[len(base) :]):
            said[name] = value
    return said


# What a file says about itself.

_MARK = re.compile(r"generated|do not (?:edit|modify)|created automatically|automatically created|produced by|edits? (?:are|will be) (?:lost|overwritten)|rebuild with|erzeugt|generiert|génér|generado|creado autom", re.I)
_TOOL = re.compile(r"\b[a-z][\w-]+ v?\d+\.\d+(?:\.\d+)?\b", re.I)
_ORIGIN = re.compile(r"\W*(?:source|input|from|quelle)\s*: \S+\.[a-z]+\W*$", re.I)
_OWNER = re.compile(r"copyright (?:\(c\)|©)?\s*[\d, -]+\s+(?:by )?(?:the )?([\w-]+) (?:authors|contributors|project|developers)", re.I)
_COMMENT = re.compile(r"[ +-]?\s*(?:#|//|\*|/\*)")
_COMMENT_LINE = re.compile(r"^[ +-]?[^\S\n]*(?:#|//|\*|/\*).*", re.M)
_NAME = re.compile(r"(.*?)(?:_[0-9a-z]{1,4})?((?:Gen|_pb2|_gen)?(?:\.(?:min|pb|g|gen|bundle))?(?:\.[0-9a-f]{6,})?\.\w+)$")
_HASH = re.compile(r"\.[0-9a-f]{6,}(?=\.)")
#: Words that stay as they are in a line's shape.
_KEPT = frozenset("def class return self pass for if else while import from var function const new package public private static final int void func struct type this __slots__ undefined null None range".split())


def declared(text: str, repo: str) -> str | None:
    """``generated`` or ``vendored`` if a comment line says so, else None.

    A generated file's line names the tool with a version beside the usual words, or the file it was made
    from; hand-written files that only talk about generated ones do not. A vendored file's line
    gives the copyright to a project other than the repository.
    """
    for m in _COMMENT_LINE.finditer(text):
        line = m.group()
        if _MARK.search(line) and _TOOL.search(line) or _ORIGIN.match(line):
            return "generated"
        m = _OWNER.search(line)
        if m and m[1].lower() != repo.lower():
            return "vendored"
    return None


#: Words and commas; a word is entered at its start only, so that time stays in proportion to the line.
_ROW = re.compile(r"(?:-|(?<!\w))\w++, ?(?:-?\w++, ?)*")


_WORD = re.compile(r"[A-Za-z_]\w*")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_AMOUNT = re.compile(r"\d+(?:\.\d+)?")


def line_shape(line: str) -> str:
    """A line with names, numbers, strings and lists abstracted; a comment has no shape."""
    if _COMMENT.match(line):
        return ""
    line = _AMOUNT.sub("0", _QUOTED.sub("s", line))
    return _ROW.sub("L", _WORD.sub(lambda m: m.group() if m.group() in _KEPT else "w", line))


#: Shapes of short lines that were seen before; longer ones, and those beyond this many, are made anew.
_SHAPES: dict[str, str] = {}
_MOST_SHAPES, _SHORT_LINE = 200_000, 80


def line_shapes(text: str) -> set[str]:
    """Shapes of the lines of a text."""
    out = set()
    for line in {*map(str.strip, text.split("\n"))}:
        shape = _SHAPES.get(line)
        if shape is None:
            shape = line_shape(line)
            if len(line) <= _SHORT_LINE and len(_SHAPES) < _MOST_SHAPES:
                _SHAPES[line] = shape
        out.add(shape)
    out.discard("")
    return out


_LITERAL = frozenset(["num", "str", "tpl", "err"])
_LAYOUT = frozenset(["nl", "indent", "dedent"])


def frame_words(read: Lexed) -> int:
    """Different names and keywords besides unquoted keys: what a table is set in, however many rows it has."""
    t = [(k, i) for i, k in enumerate(read.kinds) if k not in _LAYOUT]
    key = lambda j: t[j][0] == "id" and 0 < j < len(t) - 1 and t[j - 1][0] in ("{", ",") and t[j + 1][0] == ":"
    return len({read.text(i) for j, (k, i) in enumerate(t) if k not in _LITERAL and (k == "id" or k.isalpha()) and not key(j)})


def features(path: str, repo: str, suffix: str, text: str, p: MiningParams) -> tuple:
    import xxhash

    read = scan(text, LANGUAGES[suffix])
    # Tokens with their characters; blanks before a token in a piece do not count.
    pieces = read.pieces
    texts = [pieces[at].strip() for at in read.at if at >= 0]
    kinds = [k for k, at in zip(read.kinds, read.at) if at >= 0]
    literal = sum([len(x) for k, x in zip(kinds, texts) if k in _LITERAL])
    blank = sum(map(text.count, " \t\r\n")) / max(1, len(text))
    # A bare object or list is a JSON text under a wrong suffix, not data put into code.
    bare = next((k for k in read.kinds if k not in ("nl", "indent")), "") in ("{", "[")
    minified = not bare and blank < p.blank_share and max(map(len, text.split("\n"))) > p.long_line
    data = False
    if not bare and literal > 300:
        words = sum([len(x) for k, x in zip(kinds, texts) if k not in _LITERAL and k not in _LAYOUT and (k == "id" or k.isalpha())])
        data = words * 5 < literal and frame_words(read) <= p.data_words
    key = xxhash.xxh64_intdigest("\0".join(filter(None, texts)).encode("utf-8", "replace")) - (1 << 63)
    name = path.rsplit("/", 1)[-1]
    m = _NAME.match(name)
    stem, tail = (m[1], m[2]) if m else (name, "")
    shapes = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in sorted(line_shapes(text))]
    return path, repo, suffix, declared(text, repo or ""), minified, data, key, len(read.kinds), stem, "*" + _HASH.sub(".HASH", tail), path.split("/")[1:-1], shapes


FEATURES = "path string, repo string, suffix string, declared string, minified boolean, data boolean, key long, tokens int, stem string, name string, dirs array<string>, shapes array<long>"


def _read(p: MiningParams):
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [features(*x, p) for x in zip(pdf["path"], pdf["repo"], pdf["suffix"], pdf["content"])]
            yield pd.DataFrame(rows, columns=names).astype({"tokens": "int32", "minified": "bool", "data": "bool"})

    return run


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, rules in zip(pdf["path"], pdf["rules"]):
            said = resolve(path, [(r["base"], r["pattern"], r["name"], r["value"]) for r in rules])
            rows.append((path, next((k for k, v in said.items() if v), None), bool(said) and not any(said.values())))
        yield pd.DataFrame(rows, columns=["path", "attribute", "cleared"]).astype({"cleared": "bool"})


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(repo, i, *r) for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["content"]) for i, r in enumerate(parse_attributes(path, text))]
        yield pd.DataFrame(rows, columns=["repo", "line", "base", "pattern", "name", "value"]).astype({"line": "int32", "value": "bool"})


def attribute_marks(files: DataFrame) -> DataFrame:
    """``(path, attribute, cleared)`` for paths in repositories with attribute files."""
    declared_in = files.where(F.col("content").isNotNull() & (F.element_at(F.split("path", "/"), -1) == ".gitattributes"))
    rules = declared_in.select("repo", "path", "content").mapInPandas(_rules, "repo string, line int, base string, pattern string, name string, value boolean")
    by_repo = rules.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("base", "line", "pattern", "name", "value"))), lambda r: F.struct(r["base"].alias("base"), r["pattern"].alias("pattern"), r["name"].alias("name"), r["value"].alias("value"))).alias("rules"))
    return files.select("repo", "path").distinct().join(by_repo, "repo").select("path", "rules").mapInPandas(_resolve, "path string, attribute string, cleared boolean")


def _mined(rows: DataFrame, key: str, sign, share: float, repos: int) -> DataFrame:
    """Values of ``key`` whose rows mostly carry ``sign``, in enough repositories."""
    hit = F.when(sign, F.col("repo"))
    return rows.groupBy(key).agg(F.avg(sign.cast("double")).alias("s"), F.countDistinct(hit).alias("r")).where((F.col("s") >= share) & (F.col("r") >= repos)).select(key)


def judge_files(files: DataFrame, p: MiningParams = MiningParams()) -> DataFrame:
    """``(path, repo, suffix, reasons)`` for every source file; no reasons: hand-written.

    Declarations come first: attribute files where a repository has them, then comment
    lines. From the declared files equivalent patterns are mined and applied to the rest: code
    found in several repositories, names of vendored libraries, directories that hold nothing else, name
    patterns of tools, and shapes of lines. Minified text and data are told by their form. What an
    attribute file unsets stays hand-written. A path delivered twice counts once; null contents and
    other suffixes give no row. Mined tables are joined, not broadcast by hint: they grow with the data.
    """
    known = files.where(F.col("path").isNotNull() & F.col("content").isNotNull() & F.col("suffix").isin(*CODE))
    f = cut_lineage(known.select("path", "repo", "suffix", "content").mapInPandas(_read(p), FEATURES).dropDuplicates(["path"]))
    marks = attribute_marks(files.select("repo", "path", "content"))
    f = f.join(marks, "path", "left").withColumn("cleared", F.coalesce("cleared", F.lit(False)))
    copies = f.where(F.col("tokens") >= p.copy_tokens).groupBy("key").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").select("key", F.lit(True).alias("copied"))
    f = f.join(copies, "key", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    f = cut_lineage(f.withColumns({"declared": F.coalesce("attribute", "declared"), "vendored": F.coalesce(F.coalesce("attribute", "declared") == "vendored", F.lit(False)) | F.col("copied")}))
    stems = _mined(f.where(~F.col("stem").contains("_")), "stem", F.col("vendored"), p.stem_share, 2).withColumn("library", F.lit(True))
    f = cut_lineage(f.join(stems, "stem", "left").withColumns({"library": F.coalesce("library", F.lit(False))}))
    third = F.col("vendored") | F.col("library")
    other = F.coalesce(F.col("declared") == "generated", F.lit(False)) | F.col("minified") | F.col("data")
    below = f.select("path", "repo", F.explode(F.array_distinct("dirs")).alias("dir"), third.alias("third"))
    dirs = _mined(below, "dir", F.col("third"), p.dir_share, p.dir_repos)
    in_dir = below.join(dirs, "dir").select("path").distinct().withColumn("vendor_dir", F.lit(True))
    names = _mined(f.where(F.col("name").rlike(r"^\*(?:[A-Z_]|\..*\.)")), "name", third | other, p.name_share, p.name_repos).withColumn("tool_name", F.lit(True))
    # Line shapes: counts of files per shape, declared against those without any sign.
    rows = f.select("path", "suffix", F.coalesce(F.col("declared") == "generated", F.lit(False)).alias("g"), (~(third | other)).alias("h"), F.explode("shapes").alias("shape"))
    count = rows.groupBy("suffix", "shape").agg(F.sum(F.col("g").cast("long")).alias("gn"), F.sum(F.col("h").cast("long")).alias("hn")).where("gn > 0 or hn > 1")
    total = f.agg(F.count_if(F.coalesce(F.col("declared") == "generated", F.lit(False))).alias("gt"), F.count_if(~(third | other)).alias("ht")).first()
    odds = F.log((F.col("gn") + 0.1) / F.lit(total["gt"] + 1.0)) - F.log((F.col("hn") + 0.1) / F.lit(total["ht"] + 1.0))
    scored = rows.where("not g").join(count, ["suffix", "shape"], "left").groupBy("path").agg(F.avg(F.coalesce(odds, F.lit(0.0))).alias("odds"), F.count("*").alias("n"))
    like = scored.where((F.col("odds") > p.odds) & (F.col("n") >= p.least_shapes)).select("path", F.lit(True).alias("shaped"))
    out = f.join(in_dir, "path", "left").join(names, "name", "left").join(like, "path", "left")
    say = {"declared": F.col("declared").isNotNull(), "copied": F.col("copied"), "library name": F.col("library"), "vendor directory": F.col("vendor_dir"), "tool name": F.col("tool_name"), "line shapes": F.col("shaped"), "minified": F.col("minified"), "data": F.col("data")}
    reasons = F.filter(F.array(*[F.when(c & ~F.col("cleared"), F.lit(k)) for k, c in say.items()]), lambda x: x.isNotNull())
    return out.select("path", "repo", "suffix", reasons.alias("reasons"))


def hand_written(files: DataFrame, p: MiningParams = MiningParams()) -> DataFrame:
    """Paths of the source files that somebody wrote by hand for their repository."""
    return judge_files(files, p).where(F.size("reasons") == 0).select("path")


def p4_found(files: DataFrame, p: MiningParams = MiningParams()) -> DataFrame:
    """Files written by a tool, minified, copied in, or data kept as code."""
    return judge_files(files, p).where(F.size("reasons") > 0).select("path").distinct()
