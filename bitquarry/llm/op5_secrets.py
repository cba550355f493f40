"""Operator 5: secret scans with one combined deterministic automaton.

All rules' regular expressions go through subset construction and minimisation into transition
arrays; one pass over the bytes of a batch marks where matches of any rule may end. From the
marks, small automata of the rule itself, read backwards and forwards, find each match's leftmost
start and longest end; matches of a rule don't overlap, and those under its least length go.

Defined cases: null and empty texts have no spans; repeated rows give repeated rows; other columns
of the input are not looked at; offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm.automaton import Dfa, compile_rules, scan
from bitquarry.llm.common import flat_bytes, sliced, text_of


@dataclass(frozen=True)
class Rule:
    """``least`` counts the characters of the whole match, or, with ``head``, those after the longest match of ``head``."""

    kind: str
    pattern: str
    least: int = 1
    fold: bool = False
    head: str = ""
    #: The pattern's shortest matches, which the combined automaton looks for: with each open repeat cut
    #: to the least that can count, rules don't multiply each other's states. Longer ends come from the rule's own automaton.
    mark: str = ""


_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The base rules, and what well-known services document of their credentials' form.
BASE = (
    Rule("assign", _HEAD + "([A-Za-z0-9+/_.=-]+)", 6, True, _HEAD, _HEAD + "([A-Za-z0-9+/_.=-])"),
    Rule("access", "AKIA[A-Z0-9]+", 20, mark="AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]+", 24, mark="[0-9a-f]{24}"),
)
MORE = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", 40, mark="gh[opsur]_[A-Za-z0-9]"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15, mark="xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39, mark="AIza[A-Za-z0-9_-]"),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", 24, mark="[rs]k_(live|test)_[A-Za-z0-9]"),
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        self.all = compile_rules([(r.mark or r.pattern, r.fold) for r in rules])
        self.forth = [compile_rules([(r.pattern, r.fold)], search=False) for r in rules]
        self.back = [compile_rules([(r.pattern, r.fold)], search=False, backwards=True) for r in rules]
        self.head: list[Dfa | None] = [compile_rules([(r.head, r.fold)], search=False) if r.head else None for r in rules]

    def resolve(self, k: int, data: bytes, marks: np.ndarray) -> list[tuple[int, int]]:
        """The rule's leftmost, longest, non-overlapping matches, given the offsets where matches may end."""
        out, pos, at = [], 0, 0
        while at < len(marks):
            e = int(marks[at])
            at += 1
            starts = self.back[k].ends(data, e, -1, pos - 1)
            if not starts:
                continue
            start = starts[-1]
            end = self.forth[k].ends(data, start, 1, len(data))[-1]
            pos = end
            at = int(np.searchsorted(marks, pos, side="right"))
            value = start
            if self.head[k] is not None:
                value = self.head[k].ends(data, start, 1, len(data))[-1]
            if end - value >= self.rules[k].least:
                out.append((start, end))
        return out

    def batch(self, flat: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each row that has any: (start, rule, end) in bytes, sorted."""
        n = len(offsets) - 1
        stream = np.full(len(flat) + n, 255, np.uint8)  # a byte that no UTF-8 text has parts the rows
        begin = offsets[:-1] + np.arange(n)
        for i in range(n):
            stream[begin[i] : begin[i] + offsets[i + 1] - offsets[i]] = flat[offsets[i] : offsets[i + 1]]
        where, masks = scan(self.all, stream)
        out: dict[int, list[tuple[int, int, int]]] = {}
        if not len(where):
            return out
        row = np.searchsorted(begin, where - 1, side="right") - 1
        cuts = np.flatnonzero(np.diff(row)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(row)], strict=True):
            i = int(row[a])
            data = flat[offsets[i] : offsets[i + 1]].tobytes()
            spans = []
            for k in range(len(self.rules)):
                marks = where[a:z][masks[a:z] >> k & 1 != 0] - begin[i]
                if len(marks):
                    spans += [(s, k, e) for s, e in self.resolve(k, data, marks)]
            if spans:
                out[i] = sorted(spans)
        return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``: an array of (kind, start, end), by start, then in the order of the rules."""
    scanner = Scanner(rules)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            flat, offsets = flat_bytes(b.column("text"))
            found = scanner.batch(flat, offsets)
            rows = [[] for _ in range(b.num_rows)]
            for i, spans in found.items():
                points = np.concatenate([[0], np.cumsum((flat[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                rows[i] = [{"kind": rules[k].kind, "start": int(points[s]), "end": int(points[e])} for s, k, e in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = [r.kind for r in BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
