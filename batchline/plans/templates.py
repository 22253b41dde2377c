"""Stored statements with ``{{ name }}`` markers, bound as parameters rather than spliced."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from batchline.sinks.tables import quoted

_MARKER = r"\{\{-?\s*([^{}]*?)\s*-?\}\}"
# a typed literal that is one marker, a literal, a comment, a bare marker, other template tags
_PIECES = re.compile(
    r"\b(?P<type>DATE|TIMESTAMP)\s*(?P<typed>'" + _MARKER.replace("(", "(?:", 1) + r"')"
    r"|(?P<text>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<note>--[^\n]*|/\*(?!\+).*?\*/|\{#.*?#\})"
    r"|(?P<bare>\{\{.*?\}\})"
    r"|(?P<tag>\{%.*?%\})",
    re.IGNORECASE | re.DOTALL,
)


class TemplateError(ValueError):
    """A statement that cannot be bound safely."""


class UndefinedVariable(TemplateError):
    """A marker without a value."""


def bind(text: str, names: set[str]) -> str:
    """The statement with each marker as a named parameter.

    ``'{{ start_date }}'`` and ``{{ start_date }}`` both become ``:start_date``; a longer literal
    becomes the concatenation of its texts and the values as strings. Comments go, hints stay. An
    expression in a marker, a template tag or a name without a value is an error; so is, once
    Spark parses it, a marker that stands for an identifier.
    """

    def parameter(marker: str) -> str:
        name = re.fullmatch(_MARKER, marker, re.DOTALL).group(1)
        if not name.isidentifier():
            raise TemplateError(f"only plain names can be bound, not {marker}")
        if name not in names:
            raise UndefinedVariable(name)
        return f":{name}"

    def piece(match: re.Match) -> str:
        if match["note"]:
            return " "
        if match["tag"]:
            raise TemplateError(f"template tags are not supported: {match['tag']}")
        if match["typed"]:
            return f"CAST({parameter(match['typed'][1:-1])} AS {match['type']})"
        if match["bare"]:
            return parameter(match["bare"])
        inner = match["text"][1:-1]
        if "{{" not in inner:
            return match["text"]
        if re.fullmatch(_MARKER, inner, re.DOTALL):
            return parameter(inner)
        quote, parts, at = match["text"][0], [], 0
        for marker in re.finditer(r"\{\{.*?\}\}", inner, re.DOTALL):
            parts += [f"{quote}{inner[at:marker.start()]}{quote}", f"CAST({parameter(marker[0])} AS string)"]
            at = marker.end()
        parts.append(f"{quote}{inner[at:]}{quote}")
        return f"concat({', '.join(p for p in parts if p != quote * 2)})"

    return _PIECES.sub(piece, text).strip().rstrip(";")


_TOKENS = re.compile(
    r"(?P<skip>\s+|--[^\n]*|/\*(?!\+).*?\*/|\{#.*?#\})|(?P<quoted>`(?:[^`]|``)*`|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<marker>\{\{.*?\}\}|/\*\+.*?\*/)|(?P<word>\w+)|(?P<sign>.)",
    re.DOTALL,
)


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """``kind, text, begin, end`` of every token; blanks and comments are left out."""
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKENS.finditer(text) if m.lastgroup != "skip"]


def statements(text: str) -> list[str]:
    """The statements of a text: cut at semicolons outside of literals and comments."""
    out, begin = [], 0
    found = tokens(text)
    for kind, sign, at, end in [*found, ("sign", ";", len(text), len(text))]:
        if (kind, sign) == ("sign", ";"):
            if any(begin <= t[2] < at for t in found):
                out.append(text[begin:at].strip())
            begin = end
    return out


def run_statement(
    spark: SparkSession, text: str, params: Mapping[str, object] | None = None
) -> DataFrame:
    """Bind and run one statement; whatever it is, the result is a frame."""
    values = dict(params or {})
    return spark.sql(bind(text, set(values)), args=values)


def run_statements(
    spark: SparkSession, text: str, params: Mapping[str, object] | None = None
) -> list[int | None]:
    """Run the statements of a text in order. For each the rows it affected: those that an
    ``INSERT INTO`` wrote, counted on their way, those of a query, or what Spark tells of row-level
    commands of sources that have them; else null."""
    counts: list[int | None] = []
    for statement in statements(text):
        target, columns, query = split_insert(statement)
        if target is not None and is_query(query):
            counts.append(_insert(spark, target, columns, query, params))
            continue
        result = run_statement(spark, statement, params)
        if is_query(statement):
            counts.append(result.count())
        else:
            affected = [c for c in result.columns if c in ("num_affected_rows", "num_inserted_rows")]
            row = result.head() if affected else None
            counts.append(row[affected[0]] if row else None)
    return counts


def _insert(
    spark: SparkSession, target: str, columns: list[str] | None, query: str, params: Mapping[str, object] | None
) -> int:
    """Run the query of an ``INSERT INTO``, write its rows and count them on the way."""
    seen = Observation()
    rows = run_statement(spark, query, params).observe(seen, F.count(F.lit(1)).alias("rows"))
    names = f" ({', '.join(quoted(c) for c in columns)})" if columns else ""
    spark.sql(f"INSERT INTO {quoted(target)}{names} SELECT * FROM {{rows}}", rows=rows)
    return seen.get["rows"]


def _after_with(found: list[tuple[str, str, int, int]]) -> int:
    """Place of the token that follows the definitions of a leading ``WITH``; 0 without one."""
    if not found or found[0][1].upper() != "WITH":
        return 0
    depth = 0
    for i, (kind, sign, _, _) in enumerate(found):
        depth += {"(": 1, ")": -1}.get(sign, 0) if kind == "sign" else 0
        # the definitions end where a word follows a closed bracket, but for AS, commas and a limit
        # of recursion (MAX RECURSION LEVEL n)
        limit = sign.upper() == "MAX" and i + 1 < len(found) and found[i + 1][1].upper() == "RECURSION"
        if depth == 0 and i and found[i - 1][1] == ")" and kind == "word" and sign.upper() != "AS" and not limit:
            return i
    return 0


def is_query(text: str) -> bool:
    """Whether a statement only reads: ``SELECT``, ``VALUES``, ``FROM`` or ``TABLE`` after any
    definitions and brackets, and no ``INSERT INTO`` or ``INSERT OVERWRITE`` after that."""
    found = tokens(text)
    words = [t[1].upper() if t[0] == "word" else "" for t in found]
    if any(a == "INSERT" and b in ("INTO", "OVERWRITE") for a, b in zip(words, words[1:], strict=False)):
        return False
    rest = [t for t in found[_after_with(found) :] if t[1] != "("]
    return bool(rest) and rest[0][1].upper() in ("SELECT", "VALUES", "FROM", "TABLE")


def split_insert(text: str) -> tuple[str | None, list[str] | None, str]:
    """Target, column list and query of ``[WITH ..] INSERT INTO t [(a, b)] SELECT ...``.

    Comments may stand anywhere and each part of a name may be quoted; definitions before the
    ``INSERT`` go with the query. Any other statement has no target and is its own query.
    """
    found = tokens(text)
    at = _after_with(found)
    words = [t[1].upper() for t in found[at : at + 3]]
    if words[:2] != ["INSERT", "INTO"]:
        return None, None, text
    i = at + 2 + (words[2:] == ["TABLE"])
    name = []
    while i < len(found) and found[i][0] in ("word", "quoted"):
        part = found[i][1]
        name.append(part[1:-1].replace("``", "`") if found[i][0] == "quoted" else part)
        i += 1
        if i < len(found) and found[i][1] == "." and found[i][0] == "sign":
            i += 1
        else:
            break
    columns: list[str] | None = None
    if i + 1 < len(found) and found[i][1] == "(" and found[i + 1][1].upper() not in ("SELECT", "WITH", "VALUES", "FROM", "TABLE", "("):
        columns, i = [], i + 1
        while i < len(found) and found[i][1] != ")":
            if found[i][0] in ("word", "quoted"):
                columns.append(found[i][1].strip('`"'))
            i += 1
        i += 1
    if not name or i >= len(found):
        return None, None, text
    before = text[: found[at][2]] if at else ""
    query = (before + " " + text[found[i][2] :]).strip() if before.strip() else text[found[i][2] :]
    return ".".join(name), columns, query
