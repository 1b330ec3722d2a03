"""Writing a table version out: files, or another database through JDBC."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from kpiweave.plans.store import TableStore
from kpiweave.specs import SpecError

FILE_FORMATS = ("parquet", "csv", "json", "orc")


def export_table(
    store: TableStore,
    table: str,
    target: str,
    kind: str = "parquet",
    version: int | None = None,
    options: Mapping[str, Any] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Export a version; for ``jdbc`` the target is the table name and options the connection."""
    writer = store.read(table, version).write.mode(mode)
    if kind == "jdbc":
        writer.format("jdbc").options(**{k: str(v) for k, v in (options or {}).items()}).option("dbtable", target).save()
        return
    if kind not in FILE_FORMATS:
        raise SpecError(f"export takes {', '.join(FILE_FORMATS)} or jdbc; got {kind!r}")
    given = {"header": True, "escape": '"', **(options or {})} if kind == "csv" else dict(options or {})
    writer.format(kind).options(**given).save(target)
