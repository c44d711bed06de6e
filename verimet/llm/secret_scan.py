"""Secrets in texts, found by one automaton for all rules.

The automaton of the reversed rules reads each byte once, from the last to the first, and marks
where a match of which rule begins.  From the first mark of a rule on, that rule's own
automaton walks to the longest end; the next mark beyond that end follows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verimet.llm.automaton import BREAK, Automaton, backwards, either_case, marks, tree
from verimet.llm.common import annotate, raw


class Rule(NamedTuple):
    """A match counts if `all` of it, or the `value` (its last repeated part), has `least` bytes."""

    kind: str
    pattern: str
    any_case: bool = False
    value: str = ""
    least: int = 0


# Patterns and lengths of the base rules.  A run of [0-9a-f] has 16 or more
# characters just when it matches [0-9a-f]{16,}, so that limit is part of the automaton.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, "value", 12),
    Rule("access", r"AKIA[A-Z0-9]+", False, "all", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further rules; their spans come beside the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", False, "all", 40),
)
FIELDS = [("__spans", "array<struct<kind:int,start:int,end:int>>")]


class Scanner:
    """The automata of some rules."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE) -> None:
        self.rules = rules
        trees = [either_case(tree(r.pattern)) if r.any_case else tree(r.pattern) for r in rules]
        self.begins = Automaton([backwards(t) for t in trees], anchored=False)
        self.one = [Automaton([t], anchored=True) for t in trees]
        # where the value starts: the longest match of the pattern without its last run
        self.lead = [Automaton([("cat", t[1][:-1])], anchored=True) if r.value == "value" else None for r, t in zip(rules, trees, strict=True)]

    def spans(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, rule, start, end) of all matches that count, in bytes of the text."""
        data, bounds = raw(texts)
        n = len(bounds) - 1
        joined = np.full(len(data) + n, BREAK, np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(bounds))] = data
        place, bits = marks(self.begins, joined[::-1])
        place, bits = len(joined) - 1 - place[::-1], bits[::-1]
        first = bounds[:-1] + np.arange(n)
        flat = joined.tobytes()
        out = []
        for k, rule in enumerate(self.rules):
            starts = place[(bits >> k & 1) > 0]
            i = 0
            while i < len(starts):
                at = int(starts[i])
                doc = int(np.searchsorted(first, at, "right")) - 1
                end = self.one[k].longest(flat, at, len(flat))
                size = end - at
                if rule.value == "value":
                    size = end - self.lead[k].longest(flat, at, end)
                if size >= rule.least:
                    out.append((doc, k, at - int(first[doc]), end - int(first[doc])))
                i = int(np.searchsorted(starts, end, "left"))
        return sorted(out, key=lambda s: (s[0], s[2], s[1]))

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        found = self.spans(texts)
        data, bounds = raw(texts)
        rows = np.array(found, np.int64).reshape(-1, 4)
        docs = rows[:, 0]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])  # code points before each byte
        ranges = [points[bounds[docs] + rows[:, side]] - points[bounds[docs]] for side in (2, 3)]
        of = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(texts)))]) if len(texts) else np.zeros(1)
        values = pa.StructArray.from_arrays(
            [pa.array(rows[:, 1], pa.int32()), *(pa.array(r, pa.int32()) for r in ranges)], ["kind", "start", "end"])
        return [pa.ListArray.from_arrays(pa.array(of, pa.int32()), values)]


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` with __spans: rule number, start and end (code points), by start and rule.

    Nothing is shuffled.  Cases: null text is empty; a match never spans two texts; matches
    of one rule don't overlap, those of different rules may; repeated rows get equal
    spans; no rows give no rows; further columns are kept as they are.
    """
    return annotate(docs, "text", FIELDS, Scanner(), keep, piece=4 << 20)  # compiled once, here
