"""Text, path and score expressions, all as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no meaning in a search.
STOP_WORDS = "the a an is are was were in on at to for of and or not does do did handle method function class file bug error fix issue can should this that".split()
# Suffix to language.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".scala": "scala", ".kt": "kotlin", ".sh": "bash", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".md": "markdown", ".txt": "text", ".toml": "toml", ".cfg": "ini",
    ".ini": "ini", ".xml": "xml", ".html": "html",
}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """``.py`` of ``a/b.c.py``; empty without a dot or with a leading one only."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def lines(text: Column) -> Column:
    """Lines of a text; a final line break makes a last empty line."""
    return F.split(text, "\n", -1)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def numbered(number: Column, line: Column) -> Column:
    return F.format_string("%4d | %s", number, line)


def language(path: Column, default: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit(default))


def format_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1024 * 1024, F.format_string("%.1fKB", n / 1024)).otherwise(F.format_string("%.1fMB", n / (1024 * 1024)))


def clean(text: Column, limit: int = 300) -> Column:
    """One line of at most ``limit`` characters, with dots where it was cut."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n|\r", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def tokens(text: Column) -> Column:
    """Distinct lower-case parts of names in a text: camel case and punctuation split, single characters dropped."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    return F.array_distinct(F.transform(F.filter(F.split(t, "[^a-zA-Z0-9]+"), lambda x: F.length(x) > 1), F.lower))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query that are not stop words, in order."""
    return [t for t in dict.fromkeys(query.lower().split()) if t not in STOP_WORDS]


def name_score(terms: list[str], name: Column, node_type: Column, signature: Column, docstring: Column) -> Column:
    """How well a graph node's name, signature and documentation fit query terms; 0 to 1."""
    q = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    n = float(max(1, len(terms)))
    share = lambda c: F.size(F.array_intersect(q, tokens(c))) / F.lit(n)
    s = F.when(F.array_contains(q, F.lower(name)), 1.0).otherwise(0.0) + 0.5 * share(name) + 0.3 * share(signature) + 0.2 * share(F.substring(docstring, 1, 200))
    return F.least(F.lit(1.0), s * F.when(node_type == "method", 1.1).when(node_type == "class", 1.05).otherwise(1.0))


def same_file(a: Column, b: Column) -> Column:
    """Whether two paths name the same file.

    Blanks, backslashes and outer slashes are put right first. Equal paths match, a path
    that ends with the other (at any character), and paths with the same last two parts.
    """
    norm = lambda c: F.regexp_replace(F.replace(strip(c), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    x, y = norm(a), norm(b)
    tail = lambda c: F.regexp_extract(c, "([^/]*/[^/]*)$", 1)
    return (x == y) | x.endswith(y) | y.endswith(x) | ((tail(x) != "") & (tail(x) == tail(y)))


def patch_files(patch: Column) -> Column:
    """Paths a unified diff changes, in order of appearance; none for an empty or null patch."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^\+\+\+ b/([^\r\n\t]+)"), 1))


def project_short(instance: Column) -> Column:
    """What stands before the first underscore; empty without one."""
    return F.when(F.contains(instance, F.lit("_")), F.split_part(instance, F.lit("_"), F.lit(1))).otherwise("")


def project_long(instance: Column) -> Column:
    """What stands before the last underscore; all without one."""
    return F.regexp_replace(instance, "_[^_]*$", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null where one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def fenced_json(text: Column) -> Column:
    """JSON of a model's answer as a variant: the first fenced block, else all of it, else null."""
    block = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.coalesce(F.try_parse_json(F.nullif(block, F.lit(""))), F.try_parse_json(text))
