"""Accept one read-only SELECT and nothing else, judged on Spark's own parse tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from kpiweave.session import transform_session
from kpiweave.specs import SpecError

_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
_FORBIDDEN_NODES = (_PLANS + "Command", _PLANS + "ParsedStatement", _PLANS + "ScriptTransformation")
# Functions that run arbitrary code or reach outside the tables.
_FORBIDDEN_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect"})


class GuardError(SpecError):
    """The text is not a single acceptable SELECT."""


@dataclass(frozen=True)
class CheckedSelect:
    text: str
    tables: tuple[str, ...]


def _seq(items) -> Iterator:
    for i in range(items.size()):
        yield items.apply(i)


def _nodes(plan, visible: frozenset[str] = frozenset()) -> Iterator:
    """Every plan node, also those inside subqueries and WITH clauses, with the CTE names it can see."""
    waiting = [(plan, visible)]
    while waiting:
        node, names = waiting.pop()
        yield node, names
        inner = names
        if node.getClass().getSimpleName() == "UnresolvedWith":
            # A CTE sees those before it; the body sees all of them.
            for pair in _seq(node.cteRelations()):
                waiting.append((pair._2(), inner))
                inner = inner | {str(pair._1()).lower()}
        waiting += [(child, inner) for child in _seq(node.children())]
        waiting += [(query, inner) for query in _seq(node.subqueries())]


def _select_body(plan):
    """The SELECT under ordering, limits and WITH."""
    wrappers = ("UnresolvedWith", "GlobalLimit", "LocalLimit", "Sort", "Offset")
    while plan.getClass().getSimpleName() in wrappers:
        plan = plan.children().apply(0)
    return plan


def _branches(plan) -> Iterator:
    body = _select_body(plan)
    name = body.getClass().getSimpleName()
    if name in ("Union", "Intersect", "Except", "Distinct"):
        for child in _seq(body.children()):
            yield from _branches(child)
    else:
        yield plan


def _is_bounded(plan) -> bool:
    names, node = [], plan
    while True:
        names.append(node.getClass().getSimpleName())
        if names[-1] in ("UnresolvedRelation", "SubqueryAlias", "Join") or node.children().size() != 1:
            break
        node = node.children().apply(0)
    return any(n in ("Filter", "GlobalLimit", "LocalLimit") for n in names)


def _parse(spark: SparkSession, text: str):
    """Parse tree under the settings the SELECT will run with."""
    session = transform_session(spark)
    sessions = SparkSession._get_j_spark_session_class(spark._jvm)
    before = sessions.getActiveSession()
    sessions.setActiveSession(session._jsparkSession)
    try:
        return session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise GuardError(f"could not parse SQL: {str(error).strip().splitlines()[0]}") from error
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()


def check_select(
    spark: SparkSession,
    sql: str,
    allowed_schemas: Iterable[str] | None = None,
    bounded: bool = False,
) -> CheckedSelect:
    """Return the statement (without a trailing semicolon) and the tables it names.

    ``allowed_schemas`` requires every table to be qualified by one of them; ``bounded``
    requires a WHERE or a row limit in every branch of a set operation. Must run before
    ``spark.sql``, which would execute a command at once.
    """
    text = sql.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    if not text:
        raise GuardError("exactly one statement is allowed")
    plan = _parse(spark, text)
    loader = spark.sparkContext._jvm.org.apache.spark.util.Utils
    forbidden = [loader.classForName(name, True, False) for name in _FORBIDDEN_NODES]
    tables = []
    for node, ctes in _nodes(plan):
        for kind in forbidden:
            if kind.isInstance(node):
                raise GuardError(f"only SELECT statements are allowed, not {node.getClass().getSimpleName()}")
        if node.getClass().getSimpleName() == "UnresolvedTableValuedFunction":
            function = str(node.name().apply(node.name().size() - 1)).lower()
            if function in _FORBIDDEN_FUNCTIONS:
                raise GuardError(f"function {function} is not allowed")
        if node.getClass().getSimpleName() == "UnresolvedRelation":
            parts = [str(p) for p in _seq(node.multipartIdentifier())]
            if len(parts) == 1 and parts[0].lower() in ctes:
                continue
            tables.append(".".join(parts))
        for expression in _seq(node.expressions()):
            _check_functions(expression)
    if allowed_schemas is not None:
        allowed = {s.lower() for s in allowed_schemas}
        for name in tables:
            schema = name.rpartition(".")[0].rpartition(".")[2].lower()
            if not schema:
                raise GuardError(f"table {name!r} must be qualified by an allowed schema")
            if schema not in allowed:
                raise GuardError(f"schema {schema!r} is not allowed")
    if bounded and not all(map(_is_bounded, _branches(plan))):
        raise GuardError("query must be bounded by WHERE or a row limit")
    return CheckedSelect(text, tuple(dict.fromkeys(tables)))


def _check_functions(expression) -> None:
    waiting = [expression]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "UnresolvedFunction":
            parts = [str(p).lower() for p in _seq(node.nameParts())]
            if parts[-1] in _FORBIDDEN_FUNCTIONS:
                raise GuardError(f"function {parts[-1]} is not allowed")
        waiting += list(_seq(node.children()))
