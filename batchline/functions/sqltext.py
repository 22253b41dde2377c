"""What a stored statement says about its date fields, as expressions over the text column.

The text is cut into tokens once; fields, aliases and targets are then found by the tokens that
stand next to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# what a statement is cut into: literals, markers, (dotted) names, comparisons, other signs
_TOKEN = r"(?s)'[^']*'|\"[^\"]*\"|\{\{.*?\}\}|[\w.]+|[<>!]=|<>|\S"
_NAME = r"^[\w.]+$"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0))


def _is(token: Column, *words: str) -> Column:
    return F.coalesce(F.upper(token).isin(*words), F.lit(False))


def _stands_for(token: Column, name: str) -> Column:
    """Whether a token is a marker of this name, or a literal that begins with one."""
    return F.coalesce(F.regexp_like(token, F.lit(r"^['\"]?\{\{\s*" + name + r"\s*\}\}")), F.lit(False))


def _field_before(tokens: Column, end: Column) -> Column:
    """The field of the operand whose last token is at ``end``: a name, or the name within one
    call or cast; null for anything else."""

    def at(back: int) -> Column:
        return F.get(tokens, end - back)

    cast = (at(0) == ")") & _is(at(2), "AS") & (at(4) == "(")
    call = (at(0) == ")") & (at(2) == "(")
    name = F.when(cast, at(3)).when(call, at(1)).when(at(0) != ")", at(0))
    return F.when(name.rlike(_NAME), name)


def core_field(expression: Column) -> Column:
    """``CAST(x AS t)`` and ``f(x)`` become ``x``."""

    def inner(tokens: Column) -> Column:
        return _field_before(tokens, F.size(tokens) - 1)

    return F.coalesce(_with(_tokens(expression), inner), F.trim(expression))


def bound_fields(sql: Column, names: Sequence[str] = ("start_date", "end_date")) -> Column:
    """Sorted distinct fields that a statement compares with its date parameters."""

    def found(tokens: Column) -> Column:
        def field(token: Column, i: Column) -> Column:
            marked = F.lit(False)
            for name in names:
                marked = marked | _stands_for(token, name)
            compared = marked & _is(F.get(tokens, i - 1), "<=", ">=", "=", "<", ">")
            if "start_date" in names:
                between = _is(F.get(tokens, i - 1), "BETWEEN") & _is(F.get(tokens, i + 1), "AND")
                compared = compared | (
                    _stands_for(token, "start_date") & between & _stands_for(F.get(tokens, i + 2), "end_date")
                )
            return F.when(compared, _field_before(tokens, i - 2))

        return F.filter(F.transform(tokens, field), lambda f: f.isNotNull())

    return F.array_sort(F.array_distinct(_with(_tokens(sql), found)))


def select_aliases(sql: Column) -> Column:
    """Map from field to alias for the plain ``a.b AS c`` items of the first select list.

    The last of several aliases of one field wins.
    """

    def items(tokens: Column) -> Column:
        upper = F.transform(tokens, F.upper)
        first = F.array_position(upper, "SELECT")
        listed = F.slice(tokens, F.greatest(first, F.lit(1)), F.size(tokens))
        until = F.array_position(F.transform(listed, F.upper), "FROM")
        found = (first > 0) & (until > 0)
        return F.when(found, F.slice(listed, 1, until - 1)).otherwise(F.array().cast("array<string>"))

    def pairs(listed: Column) -> Column:
        def pair(token: Column, i: Column) -> Column:
            begins = (i == 1) | (F.get(listed, i - 1) == ",")
            named = _is(F.get(listed, i + 1), "AS") & F.get(listed, i + 2).rlike(r"^\w+$")
            return F.when(
                (i > 0) & begins & token.rlike(_NAME) & named,
                F.struct(token.alias("key"), F.get(listed, i + 2).alias("value")),
            )

        return F.filter(F.transform(listed, pair), lambda p: p.isNotNull())

    def last(found: Column) -> Column:
        def stays(pair: Column, i: Column) -> Column:
            later = F.slice(found, i + 2, F.size(found))
            return ~F.exists(later, lambda other: other["key"] == pair["key"])

        return F.map_from_entries(F.filter(found, stays))

    return _with(_tokens(sql), lambda t: _with(items(t), lambda x: _with(pairs(x), last)))


def target_date_field(fields: Column, aliases: Column) -> Column:
    """The output field that holds the window date, from bound fields and select aliases.

    The alias of a bound field, else a bound field without a qualifier, else null; with
    several candidates the first bound field in text order of names.
    """
    renamed = F.filter(F.transform(fields, lambda f: F.try_element_at(aliases, f)), lambda a: a.isNotNull())
    bare = F.filter(fields, lambda f: ~f.contains("."))
    return F.coalesce(F.get(renamed, F.lit(0)), F.get(bare, F.lit(0)))


def insert_target(sql: Column) -> Column:
    """The table named after ``INSERT INTO``, else null."""

    def name(tokens: Column) -> Column:
        def after(token: Column, i: Column) -> Column:
            here = _is(token, "INSERT") & _is(F.get(tokens, i + 1), "INTO")
            opened = F.get(tokens, i + 2).isin("`", "[")
            return F.when(here, F.when(opened, F.get(tokens, i + 3)).otherwise(F.btrim(F.get(tokens, i + 2), F.lit('"'))))

        return F.get(F.filter(F.transform(tokens, after), lambda t: F.regexp_like(t, F.lit(r"^[a-zA-Z0-9_.]+$"))), F.lit(0))

    return _with(_tokens(sql), name)


def window_delete(sql: Column, target: Column | None = None) -> Column:
    """The templated delete of one window from the insert target (or the table given)."""
    table = insert_target(sql) if target is None else F.coalesce(target, insert_target(sql))
    # Fixed value: the statement's text and its column.
    text = (
        "DELETE FROM %s\nWHERE summary_date >= '{{ start_date }}'\n"
        "  AND summary_date < '{{ end_date }}';"
    )
    return F.when(table.isNotNull(), F.format_string(text, table))
