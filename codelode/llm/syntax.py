"""Source files that do not parse: token pairs, nesting, and statement productions.

Files are lexed into token tables; one row is one token. What the windows over a file and over
a level of its brackets give (depth, partner, the sequence of a level) is reduced in the task that lexed
the file, many files at a time, since a file's tokens never leave it. What goes on as rows of
a DataFrame are the distinct pairs of neighbours, which are anti-joined, and the distinct levels.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.llm import grammars, places
from codelode.llm.documented import PAIR_FIELDS, pair_rows
from codelode.llm.lexing import CLOSE, KEYWORDS, LANGUAGES, OPEN, OPERATORS, scan
from codelode.session import cut_lineage

LEXED = "path string, repo string, lang string, pairs array<int>, nested boolean, shapes array<long>, fresh array<struct<h: long, shape: binary>>"
NAMES = {"py": "python", "java": "java", "js": "javascript", "go": "go", "json": "json"}
#: Tokens whose windows are reduced together, and rows of small results that are broadcast; larger ones are joined.
TABLE_TOKENS, SMALL_ROWS = 200_000, 100_000


@cache
def alphabet(lang: str) -> list[str]:
    """All kinds of a language, each with its place as its code; the first stands for the file itself."""
    kinds = {"id", "num", "str", "tpl", "err", "nl", "indent", "dedent", *"()[]{}", *KEYWORDS[lang], *OPERATORS[lang], *grammars.grammar(lang).terminals, *places.TOKENS}
    names = ["file", *sorted(kinds - {"file"}), "^", "$"]
    if len(names) > 255:
        raise ValueError(f"too many kinds for a byte: {lang}")
    return names


@cache
def _codes(lang: str) -> dict[str, int]:
    return {k: i for i, k in enumerate(alphabet(lang))}


#: Bracket kinds by number: opening ones positive, their partners negative.
_KIND = {k: i + 1 for i, k in enumerate(OPEN)} | {k: -list(OPEN).index(o) - 1 for k, o in CLOSE.items()}


@cache
def _brackets(lang: str) -> np.ndarray:
    return np.array([_KIND.get(k, 0) for k in alphabet(lang)], dtype=np.int8)


@cache
def _signals(lang: str) -> np.ndarray:
    return np.array([k in places.SIGNAL[lang] for k in alphabet(lang)])


#: Marks of codes on a level: ends a statement, goes on with one, a decorator, a round group, heads a list, a line break that a head without braces may precede.
END, ON, DECORATOR, ROUND, LIST, BREAK = 1, 2, 4, 8, 16, 32


@cache
def _marks(lang: str) -> np.ndarray:
    def mark(k: str) -> int:
        m = END * (k in places.ENDS[lang]) | ON * (k in places.GOES_ON[lang]) | LIST * (k in places.LISTS[lang])
        return m | DECORATOR * (lang == "py" and k == "@") | ROUND * (k in ("()", "(.)")) | BREAK * (lang == "js" and k == "nl")

    return np.array([mark(k) for k in alphabet(lang)], dtype=np.uint8)


@cache
def _later(lang: str) -> dict[int, bytes]:
    """Code of a list of statements -> the one its later parts go by."""
    c = _codes(lang)
    return {c[k]: bytes([c[v]]) for k, v in places.LISTS[lang].items()}


class Table:
    """Tokens of many files as columns: file, code as lexed, code on its level."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.raw: list[np.ndarray] = []
        self.level: list[np.ndarray] = []
        self.tokens = 0

    def add(self, lang: str, kinds: list[str]) -> None:
        codes = _codes(lang)
        raw = np.fromiter(map(codes.__getitem__, kinds), np.uint8, len(kinds))
        self.langs.append(lang)
        self.raw.append(raw)
        named = places.placed(kinds, lang, np.flatnonzero(_signals(lang)[raw]).tolist())
        level = raw.copy()
        level[np.fromiter(named, np.int64, len(named))] = np.fromiter(map(codes.__getitem__, named.values()), np.uint8, len(named))
        self.level.append(level)
        self.tokens += len(kinds) + 1

    def pairs(self) -> list[np.ndarray]:
        """Distinct pairs of neighbours of each file, as 256 a + b."""
        out = []
        for lang, raw in zip(self.langs, self.raw):
            c = _codes(lang)
            k = np.concatenate(([c["^"]], raw, [c["$"]])).astype(np.int32)
            out.append(np.unique(k[:-1] * 256 + k[1:]))
        return out

    def reduce(self) -> tuple[list[bool], list[list[bytes]]]:
        """For each file whether its brackets nest, and the distinct statements and levels it is made of.

        Windows: over a file, the running sum of brackets is the depth; over a file and level, the bracket before a
        closing one must be its partner, and each opening bracket starts a new sequence. Sequences that are lists of
        statements are parted where one ends, so that equal statements are judged once.
        """
        n = len(self.raw)
        size = np.array([len(x) + 1 for x in self.raw], dtype=np.int64)
        first = np.cumsum(size) - size
        file = np.repeat(np.arange(n), size)
        # Every file starts with the token that stands for itself.
        level_code = np.concatenate([x for own in self.level for x in ((0,), own)]).astype(np.uint8)
        kind = np.concatenate([x for lang, own in zip(self.langs, self.raw) for x in ((0,), _brackets(lang)[own])]).astype(np.int8)
        role = np.sign(kind).astype(np.int32)
        total = np.cumsum(role)
        depth = total - np.repeat(total[first], size)
        bad = (np.minimum.reduceat(depth, first) < 0) | (depth[first + size - 1] != 0)
        # Brackets of one level of one file, in order: opening and closing ones take turns and agree in kind.
        at = np.flatnonzero(kind)
        inner = depth[at] + (kind[at] < 0)
        order = at[np.lexsort((at, inner, file[at]))]
        depth_in = depth[order] + (kind[order] < 0)
        same = np.zeros(len(order), bool)
        same[1:] = (file[order][1:] == file[order][:-1]) & (depth_in[1:] == depth_in[:-1])
        before = np.concatenate(([0], kind[order][:-1])) * same
        wrong = np.where(kind[order] < 0, before != -kind[order], before > 0)
        bad[np.unique(file[order[wrong]])] = True
        key = file * (int(depth.max(initial=0)) + 2) + np.maximum(depth, 0)
        order = np.argsort(key, kind="stable")
        starts = (kind[order] > 0) | (np.diff(key[order], prepend=-1) != 0)
        marks = np.concatenate([x for lang, own in zip(self.langs, self.level) for x in ((_marks(lang)[0],), _marks(lang)[own])]).astype(np.uint8)[order]
        head = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
        before, second = np.concatenate(([0], marks[:-1])), np.concatenate(([0, 0], marks[:-2]))[: len(marks)]
        part = ~starts & ((marks[head] & LIST) > 0) & ((before & END) > 0) & ((marks & ON) == 0) & ~(((before & BREAK) > 0) & ((second & ROUND) > 0))
        # What follows a decorator's line belongs to it.
        lines = np.flatnonzero(part | np.concatenate(([False], starts[:-1])))
        decorated = np.concatenate(([False], (marks[lines[:-1]] & DECORATOR) > 0))
        part[lines[decorated & part[lines]]] = False
        cut = np.flatnonzero(starts | part)
        data = level_code[order].tobytes()
        shapes: list[list[bytes]] = [[] for _ in range(n)]
        later = [_later(lang) for lang in self.langs]
        for f, a, b, h in zip(file[order][cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(data)], head[cut].tolist()):
            name = later[f].get(data[h])
            shapes[f].append(data[a:b] if name is None or b == h + 1 else name + data[a + (a == h) : b])
        return (~bad).tolist(), [[] if x else [*dict.fromkeys(s)] for x, s in zip(bad.tolist(), shapes)]


class _Seen:
    """Hashes of level sequences, and which of them this task has not given out before."""

    most = 500_000

    def __init__(self) -> None:
        self.known: dict[tuple[str, bytes], int] = {}

    def take(self, lang: str, shapes: list[bytes]) -> tuple[list[int], list[tuple[int, bytes]]]:
        import xxhash

        out, fresh = [], []
        for s in shapes:
            h = self.known.get((lang, s))
            if h is None:
                h = xxhash.xxh64_intdigest(s, seed=sum(map(ord, lang))) - (1 << 63)
                fresh.append((h, s))
                if len(self.known) >= self.most:
                    self.known.clear()  # the sequences come out again, and are made distinct later
                if len(s) < 256:
                    self.known[lang, s] = h
            out.append(h)
        return out, fresh


def _lex(functions: str | None):
    """Files to LEXED rows, with the functions of each file if asked for (``found``, or ``pairs`` with their code)."""
    columns = [x.split(":")[0].split()[0] for x in ("path", "repo", "lang", "pairs", "nested", "shapes", "fresh")] + (["functions"] if functions else [])

    def rows(held: list[tuple]) -> pd.DataFrame:
        table = Table()
        for _, _, lang, kinds, _ in held:
            table.add(lang, kinds)
        nested, shapes = table.reduce()
        out = []
        for (path, repo, lang, _, found), pairs, ok, s in zip(held, table.pairs(), nested, shapes):
            hashes, fresh = seen.take(lang, s)
            row = (path, repo, lang, pairs, ok, hashes, [{"h": h, "shape": x} for h, x in fresh])
            out.append((*row, found) if functions else row)
        return pd.DataFrame(out, columns=columns).astype({"nested": "bool"})

    seen = _Seen()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[tuple] = []
            n = 0
            for path, repo, suffix, text in zip(pdf["path"], pdf["repo"], pdf["suffix"], pdf["content"]):
                lang = LANGUAGES[suffix]
                comments = bool(functions) and lang in ("java", "js", "go")
                read = scan(text, lang, comments)
                found = pair_rows(text, lang, read, functions == "pairs") if functions and lang != "json" else []
                kinds = [k for k in read.kinds if k != "comment"] if comments else read.kinds
                held.append((path, repo, lang, kinds, found))
                n += len(kinds)
                if n > TABLE_TOKENS:
                    yield rows(held)
                    held, n = [], 0
            if held:
                yield rows(held)

    return run


def lexed(files: DataFrame, functions: str | None = None) -> DataFrame:
    """One LEXED row per delivered file, read once: distinct pairs, whether brackets nest, hashes of levels.

    With ``functions`` (``found`` or ``pairs``) the functions of each file come along, found in the same tokens.
    """
    known = files.where(F.col("path").isNotNull() & F.col("content").isNotNull() & F.col("suffix").isin(list(LANGUAGES)))
    schema = LEXED + (f", functions array<struct<{PAIR_FIELDS[functions]}>>" if functions else "")
    return cut_lineage(known.select("path", "repo", "suffix", "content").mapInPandas(_lex(functions), schema))


def permissible(spark: SparkSession) -> DataFrame:
    """``(lang, pair)``: every pair of kinds the grammars let stand together; fixed by the grammars."""
    rows = []
    for lang in grammars.TEXTS:
        c = _codes(lang)
        rows += [(lang, c[a] * 256 + c[b]) for a, b in sorted(grammars.neighbours(lang)) if a in c and b in c]
    return spark.createDataFrame(rows, "lang string, pair int")


def _named(lang, pair):
    """A pair of codes in words."""
    names = F.create_map(*[x for k in grammars.TEXTS for x in (F.lit(k), F.array(*[F.lit(n) for n in alphabet(k)]))])
    return F.concat_ws(" ", F.lit("pair:"), F.element_at(names[lang], F.shiftright(pair, 8) + 1), F.element_at(names[lang], pair % 256 + 1))


def bad_pairs(read: DataFrame) -> DataFrame:
    """``(path, repo, lang, reason)`` of files with neighbouring tokens that no production allows."""
    rows = read.select("path", "repo", "lang", F.explode("pairs").alias("pair"))
    wrong = rows.join(F.broadcast(permissible(read.sparkSession)), ["lang", "pair"], "left_anti")
    first = wrong.groupBy("path").agg(F.first("repo").alias("repo"), F.first("lang").alias("lang"), F.min("pair").alias("pair"))
    return first.select("path", "repo", "lang", _named(F.col("lang"), F.col("pair")).alias("reason"))


def bad_nesting(read: DataFrame) -> DataFrame:
    """``(path, repo, lang, reason)`` of files with brackets that do not pair up on their level."""
    return read.where("not nested").select("path", "repo", "lang", F.lit("nesting").alias("reason"))


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for lang, h, shape in zip(pdf["lang"], pdf["h"], pdf["shape"]):
            names = alphabet(lang)
            kinds = [names[c] for c in shape]
            if not grammars.accepts(lang, kinds):
                out.append((h, " ".join(["production:", *kinds[:40]])))
        yield pd.DataFrame(out, columns=["h", "reason"]).astype({"h": "int64"})


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A checkpointed table for a join: broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bad_productions(read: DataFrame) -> DataFrame:
    """``(path, repo, lang, reason)`` of files with a level that no production makes; equal levels are judged once."""
    tasks = max(8, int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fresh = read.select("lang", F.explode("fresh").alias("f")).select("lang", "f.h", "f.shape")
    # The number of tasks is given, so that few bytes are still judged by all cores.
    once = fresh.repartition(tasks, "lang", "h").groupBy("lang", "h").agg(F.first("shape").alias("shape"))
    wrong = cut_lineage(once.mapInPandas(_judge, "h long, reason string"))
    rows = read.select("path", "repo", "lang", F.explode("shapes").alias("h"))
    return rows.join(small(wrong), "h").select("path", "repo", "lang", "reason")


def really_invalid(suffix: str, text: str) -> bool:
    """For languages whose parser is at hand, what it says; others: the verdict stands."""
    try:
        if suffix == ".py":
            ast.parse(text)
            return False
        if suffix == ".json":

            def no(x: str):
                raise ValueError(x)

            json.loads(text, parse_constant=no)
            return False
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    return True


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[not really_invalid(s, t) for s, t in zip(pdf["suffix"], pdf["content"])]][["path"]]


def judged(files: DataFrame, read: DataFrame) -> DataFrame:
    """``invalid_files`` of files that are lexed already; written to the checkpoint folder."""
    flagged = bad_pairs(read).unionByName(bad_nesting(read)).unionByName(bad_productions(read))
    named = cut_lineage(flagged.groupBy("path").agg(F.first("repo").alias("repo"), F.first("lang").alias("lang"), F.min("reason").alias("reason")))
    again = files.where(F.col("suffix").isin(".py", ".json") & F.col("content").isNotNull()).select("path", "suffix", "content")
    ask = named.where(F.col("lang").isin("py", "json")).select("path")
    cleared = again.join(small(ask), "path", "left_semi").mapInPandas(_confirm, "path string")
    # A path delivered with two contents stays flagged if either of them is wrong.
    sound = cleared.groupBy("path").agg(F.count("*").alias("sound"))
    given = again.join(small(ask), "path", "left_semi").groupBy("path").agg(F.count("*").alias("given"))
    clear = sound.join(given, "path").where("sound = given").select("path")
    return named.join(clear, "path", "left_anti")


def invalid_files(files: DataFrame) -> DataFrame:
    """``(path, repo, lang, reason)`` of every file that does not parse as its suffix says.

    Neighbouring tokens outside the grammar-derived table, brackets that do not nest and levels that
    no production makes give the file away. What is flagged in Python and JSON is then put to
    the real parser, which can only clear it. Null contents and other suffixes give no row; a file
    delivered several times is reported once; empty .py, .js and .java files are valid.
    """
    return judged(files, lexed(files))


def syntax_rates(files: DataFrame) -> DataFrame:
    """``(repo, language, files, invalid, share)``: files counted once, language by suffix."""
    known = files.where(F.col("path").isNotNull() & F.col("content").isNotNull() & F.col("suffix").isin(list(LANGUAGES)))
    once = known.groupBy("path").agg(F.first("repo").alias("repo"), F.first("suffix").alias("suffix"))
    bad = invalid_files(files).select("path", F.lit(1).alias("bad"))
    names = F.create_map(*[F.lit(x) for s, k in LANGUAGES.items() for x in (s, NAMES[k])])
    both = once.join(bad, "path", "left").groupBy("repo", names[F.col("suffix")].alias("language")).agg(F.count("*").alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"))
    return both.withColumn("share", F.round(F.col("invalid") / F.col("files"), 6))


def p6_found(files: DataFrame) -> DataFrame:
    """Files that a parser of the suffix's language rejects."""
    return invalid_files(files).select("path").distinct()
