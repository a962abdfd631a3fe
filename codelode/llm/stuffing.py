"""Keyword-stuffed and link-list pages, by n-gram models of word classes and function words trained on the table's prose."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode.session import cut_lineage

CLASSES = ("edge", "F", "G", "S", "I", "N", "X", "U", ",", ".", ":", "-", "|", "/", ";", "#", "(", '"', "$", "?", "=", "O1", "O2", "O3", "O4", "O5", "O6")
CODE = {c: i for i, c in enumerate(CLASSES)}
FUNCTION, LONGER, SHORT, OPEN = (CODE[c] for c in ("F", "G", "S", "O1"))  # F and G: short and longer function words
LONGEST_RUN = 6


@dataclass(frozen=True)
class StuffingParams:
    unit_words: int = 12  # short lines are put together up to this many words
    often: float = 0.05  # share of a page's words from which a word is too often repeated for a function word ...
    least_often: int = 3  # ... if it occurs so many times
    z_high: float = 1.0  # deviations above prose's mean surprise that are abnormal
    z_low: float = -1.0
    z_function: float = 2.5  # deviations by which function words must be missing around a unit whose classes are abnormal ...
    z_missing: float = 3.0  # ... and around any other
    few_words: float = 0.5  # share of words among the codes below which it is enough that function words miss at all ...
    no_words: float = 0.25  # ... and below which they are not asked for
    reach: int = 4  # units before and after that are judged together with a unit
    frequent: float = 0.003  # words with this share of a language's sentences are function words
    known_language: float = 0.001  # share of all sentence words that a language must have to give function words
    sentence_words: int = 6  # words that make a line with a capital and a full stop a sentence, on average
    short: int = 3  # other words of so many letters stand for function words of languages the table lacks
    least_codes: int = 8  # class codes that a page's abnormal units must have together
    references: int = 8  # longest list of links that a written page may end with
    share: float = 0.5  # abnormal share of a page's characters


_END = re.compile(r"[.!?…]+[\"'»”)]*$")
_CORE = re.compile(r"\w(?:.*\w)?", re.S)
_URL = re.compile(r"https?://|www\.|^[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/|$)", re.I)
_FILE = re.compile(r"\.(?:py|js|go|java|json|md|txt|yml|c|h|rs|html?)$|^[\w.]+/[\w/.]+\.\w{1,5}$", re.I)
_NUMBER = re.compile(r"^[\d.,:%+-]*\d[\d.,:%]*$")
_CAMEL = re.compile(r"[a-zäöü][A-Z]|^[A-Z]{2,}$")
#: Punctuation to class; the rest counts as code punctuation.
_MARKS = {",": ",", ".": ".", "!": ".", "?": ".", "…": ".", ":": ":", "-": "-", "–": "-", "—": "-", "*": "-", "|": "|", "/": "/", ";": ";", "#": "#", "(": "(", ")": "(", "[": "(", "]": "(", '"': '"', "'": '"', "’": '"', "«": '"', "»": '"', "“": '"', "”": '"', "„": '"', "`": '"', ">": "-", "•": "-", "·": "|", "¿": '"', "¡": '"', "€": "$", "$": "$", "£": "$"}
_MONEY = {"eur", "usd", "gbp", "chf"}


_BRACKET = re.compile(r"[=(){}\[\]<>]")
_DIGIT = re.compile(r"\d")
_PARTS = re.compile(r"([-'’/.:])")
_LIST = re.compile(r"([,|;])")
_LINKS = re.compile(r"([,|;])(?=https?://|www\.)", re.I)
_DATA = re.compile(r"(data:[\w/+.=-]*(?:;[\w=-]+)*;base64,[\w+/=-]*)")
LONG = 400  # characters from which a piece is cut before its parts are looked at
ENCODED = 40  # mean characters between slashes from which a long run is encoded data, not words


_ALPHA = re.compile(r"[^\W\d_]+")
#: All ASCII characters but letters to blanks.
_APART = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def letters(low: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    return low.encode().translate(_APART).decode().split() if low.isascii() else _ALPHA.findall(low)


class Words:
    """Classes of words: frequent in sentences, short, or open; other pieces by their form.

    A word that a page repeats too often to be one of its function words is open.
    """

    def __init__(self, frequent: frozenset[str], p: StuffingParams, repeated: frozenset[str] = frozenset()) -> None:
        self.frequent, self.p, self.repeated = frequent, p, repeated

    def word(self, low: str) -> int:
        if low in self.repeated:
            return OPEN
        brief = len(low) <= self.p.short
        return (FUNCTION if brief else LONGER) if low in self.frequent else SHORT if brief else OPEN

    def core(self, core: str) -> list[int]:
        low = core.lower()
        if low in self.frequent or low.isalpha() and low not in _MONEY and not _CAMEL.search(core):
            return [self.word(low)]
        if _NUMBER.match(core):
            return [CODE["N"]]
        if low in _MONEY:
            return [CODE["$"]]
        bracketed = _BRACKET.search(core)
        if not bracketed and _LIST.search(core):
            # Words joined without blanks are words all the same.
            return [c for x in _LIST.split(core) if x for c in ([CODE[_MARKS[x]]] if x in _MARKS else self.piece(x))]
        if bracketed or "_" in core or _CAMEL.search(core) or _FILE.search(core):
            return [CODE["I"]]
        if _DIGIT.search(core):
            return [CODE["X"]]
        parts = [p for p in _PARTS.split(core) if p]
        return [CODE[_MARKS[p]] if p in _MARKS else self.word(p.lower()) for p in parts]

    def piece(self, piece: str) -> bytes:
        """Class codes of a piece of text between blanks."""
        if ";base64," in piece and len(parts := _DATA.split(piece)) > 1:
            # Embedded data is one unbroken run; every second part is such data.
            return b"".join(bytes([CODE["X"]]) if k % 2 else self.piece(x) for k, x in enumerate(parts) if x)
        if len(piece) >= LONG:
            return self.long(piece)
        if ("." in piece or "://" in piece) and _URL.search(piece) and not _FILE.search(piece.strip(".,;:()[]")):
            if _LINKS.search(piece):
                return b"".join(bytes([CODE[_MARKS[x]]]) if x in _MARKS else self.piece(x) for x in _LINKS.split(piece) if x)
            lead = b"" if piece[0].isalnum() else bytes([CODE[_MARKS.get(piece[0], "=")]])
            return lead + bytes([CODE["U"]])
        core = _CORE.search(piece)
        if not core:
            return bytes([CODE[_MARKS.get(c, "=")] for c in piece])
        out = [CODE[_MARKS.get(c, "=")] for c in piece[: core.start()]]
        out += self.core(core[0])
        out += [CODE[_MARKS.get(c, "=")] for c in piece[core.end() :]]
        return bytes(out)

    def long(self, piece: str) -> bytes:
        """Class codes of a long piece: cut at list marks, then at slashes; only an unbroken run is one ``X``."""
        out = []
        for x in _LIST.split(piece):
            if x in _MARKS:
                out.append(bytes([CODE[_MARKS[x]]]))
            elif len(x) < LONG:
                out.append(self.piece(x) if x else b"")
            elif _URL.search(x):
                out.append(bytes([CODE["U"]]))
            elif len(x) <= ENCODED * (x.count("/") + 1):
                out.extend(bytes([CODE["/"]]) if y == "/" else self.piece(y) if 0 < len(y) < LONG else bytes([CODE["X"]] * bool(y)) for y in re.split("(/)", x))
            else:
                out.append(bytes([CODE["X"]]))
        return b"".join(out)


_LOG = re.compile(r"\W*\d{1,2}:\d{2}(?::\d{2})?\b|\s*(?:File \"|Traceback|at [\w.$]+\(|[-+@]{2,}|diff )")
#: Each word begins with its letter and not with a word boundary, so that a search skips to such letters.
_LEVEL = re.compile("(?:" + "|".join(rf"{w[0]}(?<!\w{w[0]}){w[1:]}" for w in ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "PASS", "FAIL", "FAILED", "SKIP", "OK")) + r")\b")
_STARTS = ("import", "from", "break", "package", "raise", "return", "#", "//")
_STATEMENT = re.compile(r"\s*(?:(?:import|from|break|package|raise)\s+[\w.]+\s*(?:import\b.*|\(.*|;)?$|return\b.*[\w)\]};]$|#\s|//)")
_SIGN = re.compile(r"[(){}=;%]")
_KEYWORD = re.compile(r"\s*(?:(?:import|from|return|assert|def|class|func|while|for|if|try|raise|break|package|const|var|let|public|private)\b|(?:#|//)\s)")
_CALL = re.compile(r"\((?<=\w\().*\)")
_ASSIGNED = re.compile(r"=(?:(?<=\s=)|(?<=\s[=!<>+*/%&|-]=))\s")
_NAMED = re.compile(r"_(?<=\w_)\w*\s*[=(]")


def technical(line: str, fenced: bool) -> bool:
    """Logs, traces, code and tables: not sentences, but not stuffing either."""
    if fenced or line.startswith(("|", "    ", "\t")) or _LOG.match(line) or _LEVEL.search(line):
        return True
    if "://" in line or "](" in line:
        return False
    if line.lstrip().startswith(_STARTS) and _STATEMENT.match(line):
        return True
    if not _SIGN.search(line):
        return False
    return bool(line.rstrip()[-1] in "{};=" or _KEYWORD.match(line) or "->" in line or "=>" in line or "(" in line and _CALL.search(line) or "=" in line and _ASSIGNED.search(line) or "_" in line and _NAMED.search(line))


_LINK_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])?\s*(?:\[[^\]]*\]\(\S+\)|<?\w+://\S+>?)[.,;]?\s*$")
_TAG = re.compile(r"</?(?:p|b|i|u|em|strong|div|span|code|blockquote|h\d)(?:\s[^<>]*)?>")


class _Known(dict):
    """Piece to codes, with an edge after a piece that ends a sentence; long pieces, and those beyond ``most``, are classed anew each time."""

    most = 400_000

    def __init__(self, words: Words) -> None:
        self.words = words

    def __missing__(self, piece: str) -> bytes:
        c = ended(piece, self.words.piece(piece))
        if len(self) < self.most and len(piece) < 40:
            self[piece] = c
        return c


def ended(piece: str, codes: bytes) -> bytes:
    return codes + b"\0" if piece[-1] in ".!?…\"'»”)" and _END.search(piece) else codes


class Reader:
    """Texts to class codes, unit by unit; pieces seen before are looked up."""

    def __init__(self, p: StuffingParams, frequent: frozenset[str] = frozenset()) -> None:
        self.p = p
        self.words = Words(frequent, p)
        self.known = _Known(self.words)
        self.page: dict[str, bytes] = {}  # pieces of this page that hold a repeated word

    def codes(self, pieces: list[str]) -> bytes:
        """Codes of the pieces of a line, whose sentences are parted by edges."""
        known, page = self.known, self.page
        if page:
            c = b"".join([page[x] if x in page else known[x] for x in pieces])
        else:
            c = b"".join(map(known.__getitem__, pieces))
        return c[:-1] if c[-1:] == b"\0" else c

    def turn(self, text: str) -> None:
        """Looks up what a page repeats: words of four letters, and of three that are not frequent in sentences."""
        p = self.p
        found = letters(text.lower())
        count = Counter(found)
        least = max(p.least_often, p.often * len(found))
        often = frozenset(w for w, n in count.items() if n >= least and (len(w) > p.short or len(w) == p.short and w not in self.words.frequent))
        self.page = {}
        if often:
            words = Words(self.words.frequent, p, often)
            for x in {*text.split()}:
                core = x.lower().strip(_EDGES)
                if core in often or not core.isalpha() and len(x) < LONG and not often.isdisjoint(letters(core)):
                    self.page[x] = ended(x, words.piece(x))

    def references(self, lines: list[str]) -> set[int]:
        """Lines of link lists that a short heading with a colon introduces, if they are short."""
        out: set[int] = set()
        i = 0
        while i < len(lines):
            head = lines[i].strip()
            i += 1
            if head.endswith(":") and len(head) < 60:
                j = i
                while j < len(lines) and (_LINK_ITEM.match(lines[j]) or not lines[j].strip()):
                    j += 1
                own = [k for k in range(i, j) if lines[k].strip()]
                if 0 < len(own) <= self.p.references:
                    out.update(own)
                i = j
        return out

    def units(self, text: str) -> tuple[bytes, list[int], list[int], list[int]]:
        """Codes of all units, each after an edge, then lengths in codes, characters and kinds.

        Kinds: 1 technical, 2 a short list of references under a heading, else 0.
        """
        codes, lengths, sizes, kinds = [], [], [], []
        held: list[bytes] = []
        chars = words = 0

        def close(kind: int = 0) -> None:
            nonlocal chars, words
            if held:
                c = b"\0" + b"\0".join(held)
                codes.append(c)
                lengths.append(len(c))
                sizes.append(chars)
                kinds.append(kind)
                held.clear()
                chars = words = 0

        fenced = False
        if "<" in text:
            text = _TAG.sub(" ", text)
        self.turn(text)
        lines = text.split("\n")
        references = self.references(lines) if "://" in text else ()
        for at_line, line in enumerate(lines):
            pieces = line.split()
            if not pieces:
                close()
                continue
            if pieces[0].startswith("```"):
                close()
                fenced = not fenced
                continue
            size = len("".join(pieces)) + len(pieces)
            c = self.codes(pieces)
            kind = 2 if at_line in references else int(technical(line, fenced))
            if kind:
                close()
                held.append(c.replace(b"\0", b""))
                chars = size
                close(kind)
                continue
            if len(pieces) >= self.p.unit_words:
                close()
            held.append(c)
            chars, words = chars + size, words + len(pieces)
            if words >= self.p.unit_words:
                close()
        close()
        return b"".join(codes), lengths, sizes, kinds


#: Lengths and sizes as 32-bit integers, kinds as bytes.
READ = "doc_id long, codes binary, lengths binary, sizes binary, kinds binary"


_SENTENCE = re.compile(r"(?<![^\s>*-])[^\W\d_a-z][^.!?\n|<>]{30,}[.!?](?=\s|$)")


def _sentences(p: StuffingParams):
    """Counts of the words of sentences, by language as given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, Counter] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                # Page by page: the words of many pages at once are slow to make.
                if found := [x for x in _SENTENCE.findall(text) if x.count(" ") >= p.sentence_words]:
                    n.setdefault((lang or "").strip().lower(), Counter()).update(letters("\n".join(found).lower()))
        rows = [(lang, w, k) for lang, c in n.items() for w, k in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"]).astype({"n": "int64"})

    return run


def function_words(documents: DataFrame, p: StuffingParams = StuffingParams()) -> frozenset[str]:
    """The words that are frequent in the sentences of a language: at most ``1 / frequent`` a language.

    A sentence starts with a capital, ends with a full stop and has some words in between, so that
    keywords, tags and links are no sentences. All documents count.
    """
    lang = "lang" if "lang" in documents.columns else F.lit("").alias("lang")
    count = documents.where("text is not null").select(lang, "text").mapInPandas(_sentences(p), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    count = cut_lineage(count)
    total = count.groupBy("lang").agg(F.sum("n").alias("total"))
    whole = total.agg(F.sum("total")).first()[0] or 0
    known = F.broadcast(total.where(F.col("total") >= max(1.0, p.known_language * whole)))  # at most 1 / known_language rows
    return frozenset(r["word"] for r in count.join(known, "lang").where(F.col("n") >= p.frequent * F.col("total")).select("word").distinct().collect())


def _read(p: StuffingParams, frequent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(p, frequent.value)
        for pdf in batches:
            rows = []
            for k, text in zip(pdf["doc_id"], pdf["text"]):
                codes, lengths, sizes, kinds = reader.units(text)
                rows.append((k, codes, array("i", lengths).tobytes(), array("i", sizes).tobytes(), bytes(kinds)))
            yield pd.DataFrame(rows, columns=["doc_id", "codes", "lengths", "sizes", "kinds"])

    return run


def runs(codes: np.ndarray) -> np.ndarray:
    """Open-class words told apart by their place in an unbroken run of them."""
    run = (codes == OPEN).view(np.uint8)
    c = codes.copy()
    for _ in range(LONGEST_RUN - 1):
        # Whether the words before are open too, one more each time.
        run = run[1:] & run[:-1]
        c[len(c) - len(run) :] += run
    return c


def trigrams(codes: np.ndarray) -> np.ndarray:
    c = runs(codes)
    out = c.astype(np.uint16)
    out[1:] += c[:-1] * np.uint16(len(CLASSES))
    # A sentence starts anew at each edge: what stands before the edge is not seen.
    out[2:] += c[:-2] * (c[1:-1] != 0) * np.uint16(len(CLASSES) ** 2)
    return out


def _batch(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a batch with, for each unit, where it starts, its row, characters and kind."""
    codes, lengths, sizes, kinds = (np.frombuffer(b"".join(pdf[c]), dtype=t) for c, t in (("codes", np.uint8), ("lengths", np.int32), ("sizes", np.int32), ("kinds", np.uint8)))
    count = np.array([len(x) for x in pdf["kinds"]], dtype=np.int64)
    return codes, np.cumsum(lengths, dtype=np.int64) - lengths, np.repeat(np.arange(len(pdf)), count), sizes, kinds


_WORDS = np.isin(np.arange(len(CLASSES)), [FUNCTION, LONGER, SHORT, OPEN])
_ODD = np.isin(np.arange(len(CLASSES)), [CODE[x] for x in ("U", "|", "$")])


def _prose(codes: np.ndarray, start: np.ndarray, kinds: np.ndarray, p: StuffingParams) -> np.ndarray:
    """Units made of sentences: full stops, and enough words to each of them."""
    if not len(start):
        return np.zeros(0, bool)
    total = np.diff(np.append(start, len(codes)))
    words, stop, odd = (np.add.reduceat(x, start, dtype=np.int64) for x in (_WORDS[codes], codes == CODE["."], _ODD[codes]))
    return (kinds == 0) & (stop > 0) & (odd == 0) & (words >= p.sentence_words * stop) & (words * 2 > total)


#: Codes as a language gives them whose function words the table does not hold.
_UNKNOWN = np.arange(len(CLASSES), dtype=np.uint8)
_UNKNOWN[FUNCTION], _UNKNOWN[LONGER] = SHORT, OPEN


HISTORY = 5  # words before a word that say whether a function word is due
CELLS, FUNCTION_CELLS = len(CLASSES) ** 3, 2 ** (HISTORY + 1)


def words_at(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words stand, and for each its unit and its place among the unit's words."""
    is_word = _WORDS[codes]
    n = np.add.reduceat(is_word, start, dtype=np.int64)
    at = np.flatnonzero(is_word)
    return at, np.repeat(np.arange(len(start)), n), np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def function_cells(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For the code of each word the cell of (is it open, were the words before it in the unit open)."""
    is_open = (words == OPEN).view(np.uint8)
    cell = is_open.copy()
    place = np.minimum(place, HISTORY).astype(np.uint8)
    for j in range(1, HISTORY + 1):
        cell[j:] |= (is_open[:-j] & (place[j:] >= j)) << np.uint8(j)
    return cell


def _count(p: StuffingParams):
    """Trigrams and function-word sequences of prose; all of it counts twice, as it is and as if its language were unknown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(CELLS + FUNCTION_CELLS, dtype=np.int64)
        for pdf in batches:
            codes, start, _, _, kinds = _batch(pdf)
            if len(start):
                prose = _prose(codes, start, kinds, p)
                take = np.repeat(prose, np.diff(np.append(start, len(codes))))
                at, unit, place = words_at(codes, start)
                own = prose[unit]
                for c in (codes, _UNKNOWN[codes]):
                    n[:CELLS] += np.bincount(trigrams(c)[take], minlength=CELLS)
                    n[CELLS:] += np.bincount(function_cells(c[at], place)[own], minlength=FUNCTION_CELLS)
        cell = np.flatnonzero(n)
        yield pd.DataFrame({"cell": cell, "n": n[cell]})

    return run


@dataclass(frozen=True)
class Model:
    """Bits of each trigram of classes, and for each function-word cell how far it exceeds the open words due there, and their variance."""

    bits: np.ndarray
    excess: np.ndarray
    variance: np.ndarray


def fit(counts: np.ndarray) -> Model:
    """The two models of prose. Trigrams are interpolated with bigrams and single classes (Witten-Bell weights)."""
    k = len(CLASSES)
    tri = counts[:CELLS].reshape(k, k, k).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))

    def mix(n: np.ndarray, below: np.ndarray) -> np.ndarray:
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True) + 1
        return (n + kinds * below) / (total + kinds)

    p = mix(tri, np.broadcast_to(mix(bi, np.broadcast_to(mix(uni, np.full(k, 1 / k)), (k, k))), (k, k, k)))
    q = counts[CELLS:].reshape(-1, 2).astype(float)
    q = mix(q, np.broadcast_to(mix(q.sum(0), np.full(2, 0.5)), q.shape))
    due = q[:, 1:]  # of an open word after this history
    return Model(-np.log2(p).ravel(), (np.array([0.0, 1.0]) - due).ravel(), np.broadcast_to(due * (1 - due), q.shape).ravel())


def _unit_sums(pdf: pd.DataFrame, model: Model, p: StuffingParams):
    """For each unit its bits, codes, function-word excess and variance, words, row, characters, kind, and whether it is prose."""
    codes, start, row, sizes, kinds = _batch(pdf)
    if not len(start):
        return None
    at, unit, place = words_at(codes, start)
    cell = function_cells(codes[at], place)
    by_unit = lambda x: np.bincount(unit, x, len(start))
    bits = np.add.reduceat(model.bits[trigrams(codes)], start)
    return bits, np.diff(np.append(start, len(codes))), by_unit(model.excess[cell]), by_unit(model.variance[cell]), np.bincount(unit, minlength=len(start)), row, sizes, kinds, _prose(codes, start, kinds, p)


def around(row: np.ndarray, reach: int, *sums: np.ndarray) -> list[np.ndarray]:
    """Sums over each unit and up to ``reach`` units of its page before and after."""
    at = np.arange(len(row))
    lo = np.maximum(at - reach, np.searchsorted(row, row))
    hi = np.minimum(at + reach + 1, np.searchsorted(row, row, side="right"))
    totals = (np.concatenate(([0.0], np.cumsum(x))) for x in sums)
    return [total[hi] - total[lo] for total in totals]


def _moments(model, p: StuffingParams):
    """Sums from which mean and spread of prose are found, for classes and for function words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros(6)
        for pdf in batches:
            got = _unit_sums(pdf, model.value, p)
            if got:
                bits, n, excess, variance, _, row, _, kinds, prose = got
                m, w = bits[prose] / n[prose], n[prose]
                own = np.flatnonzero(kinds == 0)
                z = np.zeros(len(n))
                e, v = around(row[own], p.reach, excess[own], variance[own])
                z[own] = e / np.sqrt(np.maximum(v, 1e-9))
                s += (len(m), w.sum(), (m * w).sum(), (m * m * w).sum(), z[prose].sum(), (z[prose] ** 2).sum())
        yield pd.DataFrame([s], columns=["units", "n", "sum", "squares", "f_sum", "f_squares"])

    return run


@dataclass(frozen=True)
class Spread:
    """Mean and spread of prose: bits a class, and deviations of function words."""

    mean: float = 4.0
    spread: float = 1.0
    f_mean: float = 0.0
    f_spread: float = 1.0


def spread_of(units: float, n: float, total: float, squares: float, f_sum: float, f_squares: float) -> Spread:
    if not units:
        return Spread()
    mean, f_mean = total / n, f_sum / units
    # Units of n codes deviate by about spread / sqrt(n).
    spread = max(0.2, float(np.sqrt(max(squares / n - mean**2, 0.0) * n / units)))
    return Spread(mean, spread, f_mean, max(0.2, float(np.sqrt(max(f_squares / units - f_mean**2, 0.0)))))


def _judge(model, s: Spread, p: StuffingParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = _unit_sums(pdf, model.value, p)
            if not got:
                continue
            bits, n, excess, variance, words, row, sizes, kinds, _ = got
            z = (bits / n - s.mean) / s.spread * np.sqrt(n)
            own = np.flatnonzero(kinds == 0)
            due, share = np.zeros(len(n)), np.zeros(len(n))
            e, v, some, every = around(row[own], p.reach, excess[own], variance[own], words[own], n[own])
            due[own] = e / np.sqrt(np.maximum(v, 1e-9))
            share[own] = some / every
            missing = (due - s.f_mean) / s.f_spread
            rare = (z > p.z_high) | (z < p.z_low)
            odd = (kinds == 0) & ((missing > p.z_missing) | rare & ((missing > p.z_function) | (share < p.few_words) & ((missing > 0) | (share < p.no_words))))
            written = np.bincount(row, (kinds == 0) & ~odd, len(pdf)) > 0
            odd |= (kinds == 2) & ~written[row]
            odd &= np.bincount(row, n * odd, len(pdf))[row] >= p.least_codes
            w = np.bincount(row, sizes, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "units": np.bincount(row, minlength=len(pdf)), "share": np.bincount(row, sizes * odd, len(pdf)) / np.maximum(w, 1), "technical": np.bincount(row, sizes * (kinds == 1), len(pdf)) / np.maximum(w, 1), "perplexity": 2.0 ** (np.bincount(row, bits, len(pdf)) / np.maximum(np.bincount(row, n, len(pdf)), 1))})

    return run


JUDGED = "doc_id long, units long, share double, technical double, perplexity double"


def judge_pages(documents: DataFrame, p: StuffingParams = StuffingParams()) -> DataFrame:
    """``(doc_id, units, share, technical, perplexity)`` of every page with words.

    Texts are read once for the frequent words of their sentences, and once, whole, into class codes of units
    (a line, or several short ones). Two n-gram models of all prose units of the table judge them; their size is fixed
    by the number of classes. One gives the surprise of word-class sequences, the other the function words that
    the words before let expect. ``share`` is the part of the characters in units without due function words whose
    surprise is abnormally high or low, or that lack function words altogether, and that are not logs, traces, code
    or tables. Null and blank texts give no rows. Repeated ids are judged row by row.
    """
    spark = documents.sparkSession
    frequent = spark.sparkContext.broadcast(function_words(documents, p))
    read = cut_lineage(documents.where("text is not null and text rlike '[^\\\\s]'").select("doc_id", "text").mapInPandas(_read(p, frequent), READ))
    counts = np.zeros(CELLS + FUNCTION_CELLS, dtype=np.int64)
    for r in read.mapInPandas(_count(p), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    model = spark.sparkContext.broadcast(fit(counts))
    names = ("units", "n", "sum", "squares", "f_sum", "f_squares")
    m = read.mapInPandas(_moments(model, p), ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c).alias(c) for c in names)).first()
    return read.mapInPandas(_judge(model, spread_of(*(m[c] or 0.0 for c in names)), p), JUDGED)


def p9_found(documents: DataFrame, p: StuffingParams = StuffingParams()) -> DataFrame:
    """Pages of which more than half is keywords, tags, links or product entries."""
    return judge_pages(documents, p).where(F.col("share") > p.share).select("doc_id").distinct()
