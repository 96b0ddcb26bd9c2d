"""Secret scan: all rules in one deterministic automaton, one pass over a text's bytes.

The combined automaton marks which rules a text can match at all; most texts match none and
cost that one pass. Where a rule is marked, its own automaton gives the leftmost longest
non-overlapping spans, which are then checked for length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.llm import text as tx
from tidepair.llm.automaton import Automaton, _Parser


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; those of fewer than ``least`` bytes (after ``head``) are dropped.

    ``marker`` is what any kept span holds, so that texts without it need no second look; it
    has few counted parts, since states of the combined automaton multiply with those.
    ``head`` is the part before the value whose length counts. A span can't start behind a byte
    of ``apart``: where a long run of such bytes fails, its other places need no look.
    """

    kind: str
    pattern: str
    marker: str
    least: int = 0
    head: str = ""
    apart: str = ""


_ASSIGN_HEAD = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=\-]"
#: A key is secret from its first line to its last, or its first line alone where the last is missing.
_KEY_LINE = r"-----{}\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----"
_VENDOR = r"(gh[pousr]_|github_pat_|glpat-|xox[baprs]-|sk_live_|sk_test_|AIza|npm_|hf_)"
#: Kinds in the order in which ties at one start are listed; the first three are the base.
RULES = (
    Rule("assign", f"{_ASSIGN_HEAD}{_VALUE}+", f"{_ASSIGN_HEAD}{_VALUE}", 12, _ASSIGN_HEAD),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 18),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{16}", 16),
    Rule("private_key", f"{_KEY_LINE.format('BEGIN')}(([^\\-]|-[^\\-])*{_KEY_LINE.format('END')})?", r"-----BEGIN\x20"),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", r"\.eyJ[A-Za-z0-9_\-]", 40, apart=r"[A-Za-z0-9_\-]"),
    Rule("vendor_token", f"{_VENDOR}[A-Za-z0-9_\\-]+", f"{_VENDOR}[A-Za-z0-9_\\-]", 24),
    Rule("url_password", r"[a-z][a-z0-9+.\-]{0,31}://[A-Za-z0-9._~%\-]+:[A-Za-z0-9._~%!$&*+=\-]+@", r"://[A-Za-z0-9._~%\-]+:", 12, apart="[a-z]"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/=\-]+", r"(?i)bearer\x20", 27),
)
BASE = 3


class Scanner:
    """Compiled rules: the combined automaton and one automaton a rule and head."""

    def __init__(self, rules: tuple = RULES):
        self.rules = rules
        self.all = Automaton([r.marker for r in rules], search=True)
        self.each = [Automaton([r.pattern], search=False) for r in rules]
        self.heads = [Automaton([r.head], search=False) if r.head else None for r in rules]
        self.apart = [_Parser(r.apart).atom()[1] if r.apart else frozenset() for r in rules]
        self.starts = []
        for one in self.each:
            begins = {k for k in range(one.width) if one.table[k] != one.dead * one.width}
            self.starts.append(bytes(one.classes[b] in begins for b in range(256)))

    def marked(self, data: bytes) -> set[int]:
        """Rules whose marker the text holds: the one pass over its bytes."""
        table, good, found, state = self.all.table, self.all.first_accept, set(), 0
        for c in data.translate(self.all.classes):
            state = table[state + c]
            if state >= good:
                found.add(state)
        return {k for s in found for k in self.all.accepts[s // self.all.width]}

    def spans_of(self, k: int, data: bytes) -> list[tuple[int, int]]:
        one, head, rule = self.each[k], self.heads[k], self.rules[k]
        coded, begins = data.translate(one.classes), data.translate(self.starts[k])
        spans, at, apart = [], begins.find(1), self.apart[k]
        while at >= 0:
            if at and data[at - 1] in apart:
                at = begins.find(1, at + 1)
                continue
            end = one.longest(coded, at)
            if end < 0:
                end = at + 1
            else:
                value = head.longest(data[:end].translate(head.classes), at) if head else at
                if end - value >= rule.least:
                    spans.append((at, end))
            at = begins.find(1, end)
        return spans

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start and then rule."""
        found = []
        for k in sorted(self.marked(data)):
            for a, b in self.spans_of(k, data):
                start = len(data[:a].decode(errors="replace"))
                found.append((start, start + len(data[a:b].decode(errors="replace")), k))
        return sorted(found, key=lambda s: (s[0], s[2]))


_scanner: Scanner | None = None


def scanner() -> Scanner:
    """The compiled rules, built once a process."""
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    return _scanner


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every row: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_secrets).

    ``spans`` lists ``kind:start:end`` in code points (end exclusive) by start, then kind as
    listed; ``base_sha256`` is the digest of that list for the base kinds alone. Each kind's
    spans are leftmost, longest and apart from each other; kinds may overlap. A null text
    counts as empty: no span. Repeated rows are scanned alike; an empty table gives none.
    """

    def fn(batch, texts):
        compiled = scanner()
        counts, digests, listed = [[], [], []], [], []
        for data in texts:
            spans = compiled.scan(data)
            names = [f"{compiled.rules[k].kind}:{a}:{b}" for a, b, k in spans]
            base = ",".join(n for n, s in zip(names, spans, strict=True) if s[2] < BASE)
            for k in range(BASE):
                counts[k].append(sum(s[2] == k for s in spans))
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            listed.append(",".join(names))
        return batch.column("doc_id"), *counts, digests, listed, [s.count(",") + 1 if s else 0 for s in listed]

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return tx.map_texts(rows, fn, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_secrets long")


def mask(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span replaced; overlapping spans are replaced as one.

    Columns stay as they are; ``n_chars``, where there is one, follows the new text. A null
    text stays null.
    """
    columns, has_length = docs.columns, "n_chars" in docs.columns

    def run(batches):
        compiled, at = scanner(), columns.index("text")
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(at).cast(pa.binary()).fill_null(b"")).to_pylist()
            for lo, hi in tx.slices(sizes):
                yield masked(compiled, batch.slice(lo, hi - lo), at)

    def masked(compiled, batch, at):
        texts = batch.column(at).to_pylist()
        changed = False
        for i, text in enumerate(texts):
            spans = compiled.scan(text.encode()) if text else ()
            if not spans:
                continue
            changed, parts, done = True, [], 0
            merged: list[list[int]] = []
            for a, b, _ in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                parts += [text[done:a], by]
                done = b
            texts[i] = "".join(parts) + text[done:]
        if not changed:
            return batch
        held = list(batch.columns)
        held[at] = pa.array(texts, type=batch.schema.field(at).type)
        if has_length:
            n = columns.index("n_chars")
            held[n] = pa.array([None if t is None else len(t) for t in texts]).cast(batch.schema.field(n).type)
        return pa.RecordBatch.from_arrays(held, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
