"""Secret scans: all rules in one deterministic automaton, one pass over the bytes.

The rules are compiled together by subset construction and minimisation, each up to the byte
from which a match is likely, as long counters of several rules would multiply the states.
One pass over the bytes tells which rules to look for in which texts; there a
mirrored automaton of the rule marks where its matches begin, and from the leftmost mark an
anchored one gives the longest match, and so on behind it: leftmost, not overlapping, for
each kind by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiweave.llm.automata import Scanner, compile_rules, longest_from, states_after
from kpiweave.llm.common import slices, whole_text

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
#: Bytes scanned at once by a task.
RUN_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body``; a match whose body has fewer than ``least`` bytes is dropped.

    ``sieve``: what each match begins with; the pass over all texts looks for it.
    """

    kind: str
    head: str
    body: str
    sieve: str
    least: int = 1
    base: bool = False


# The base kinds and their patterns, in the order in which they are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=\-]+",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]""",
        6,
        True,
    ),
    Rule("access", r"AKIA", r"[A-Z0-9]{16,}", r"AKIA[A-Z0-9]", 16, True),
    Rule("hex", r"", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 24, True),
)
#: Forms of public services' keys that the base kinds do not take in.
MORE_RULES = (
    Rule("private_key", r"", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", r"-----BEGIN "),
    Rule("web_token", r"eyJ", r"[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+", r"eyJ[A-Za-z0-9_\-]"),
    Rule("forge_token", r"gh[pousr]_", r"[A-Za-z0-9]{36,}", r"gh[pousr]_"),
    Rule("chat_token", r"xox[abprs]-", r"[A-Za-z0-9\-]{10,}", r"xox[abprs]-"),
)
RULES = BASE_RULES + MORE_RULES


class Scan:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        each = [r.head + r.body for r in rules]
        self.all = compile_rules([r.sieve for r in rules], anywhere=True)
        self.begins = [compile_rules([x], anywhere=True, mirrored=True) for x in each]
        self.whole = [compile_rules([x], anywhere=False) for x in each]
        self.head = [compile_rules([r.head], anywhere=False) if r.head else None for r in rules]

    def texts(self, texts: list[bytes]) -> dict[int, list[tuple[str, int, int]]]:
        """Spans in code points of the texts that have any, by start and then by rule."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return {}
        ends = np.cumsum([len(t) for t in texts])
        marks = self.all.accepts[states_after(self.all, data, ends) // self.all.width]
        at = np.flatnonzero(marks)
        rules = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(rules, np.searchsorted(ends, at, side="right"), marks[at])
        found: dict[int, list[tuple[str, int, int]]] = {}
        for i in np.flatnonzero(rules).tolist():
            if spans := self._spans(texts[i], int(rules[i])):
                found[i] = spans
        return found

    def _spans(self, text: bytes, rules: int) -> list[tuple[str, int, int]]:
        chosen = []
        data = np.frombuffer(text, np.uint8)
        for k, rule in enumerate(self.rules):
            if not rules >> k & 1:
                continue
            begins, behind = self.begins[k], 0
            states = states_after(begins, data, np.array([len(data)]), leftward=True)
            for start in np.flatnonzero(begins.accepts[states // begins.width]).tolist():
                if start < behind:
                    continue
                behind = longest_from(self.whole[k], text, start)
                body = max(start, longest_from(self.head[k], text, start)) if self.head[k] else start
                if behind - body >= rule.least:
                    chosen.append((start, k, behind))
        if not chosen:
            return []
        points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        return [(self.rules[k].kind, int(points[s]), int(points[e])) for s, k, e in sorted(chosen)]


def scanner_of(rules: tuple[Rule, ...] = RULES):
    """A column function: text to its spans, or null where it has none."""
    scan = Scan(rules)

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows: list = []
            for run in slices(batch, RUN_BYTES):
                texts = [t or b"" for t in run.to_pylist()]
                found = scan.texts(texts)
                rows += [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in found[i]] if i in found else None for i in range(len(texts))]
            yield pa.array(rows, kind)

    return spans


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the spans (kind, start, end in code points, end exclusive) of each whole text.

    Null and empty texts have an empty list. Repeated rows are scanned alike; further columns stay,
    one already named ``spans`` is replaced. An empty table gives an empty table.
    """
    none = F.lit(None).cast(SPANS)
    return docs.withColumn(spans, F.coalesce(scanner_of(rules)(whole_text(text)), F.coalesce(none, F.array().cast(SPANS))))


def with_kinds(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    parts, behind = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= behind:
            parts += [text[behind:start], f"[{kind}]"]
        behind = max(behind, end)
    return "".join([*parts, text[behind:]])


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, rows in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            out.append(with_kinds(t, [(r["kind"], r["start"], r["end"]) for r in rows]) if t is not None and rows else t)
        return pa.array(out, pa.string())

    return mask(text, spans)


def mask_secrets(docs: DataFrame, text: str = "text", changed: str = "changed", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``text`` masked as by ``masked``, and whether it has a secret; found and masked in one pass.

    Only changed texts come back from the Python worker, of which a task needs one. Null texts stay null.
    """
    scan = Scan(rules)

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str | None] = []
            for run in slices(batch, RUN_BYTES):
                texts = [t or b"" for t in run.to_pylist()]
                found = scan.texts(texts)
                out += [with_kinds(t.decode(), found[i]) if i in found else None for i, t in enumerate(texts)]
            yield pa.array(out, pa.string())

    found = docs.withColumn("__masked", mask(whole_text(text))).withColumn(changed, F.col("__masked").isNotNull())
    return found.withColumn(text, F.coalesce("__masked", text)).drop("__masked")


def spelled(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
