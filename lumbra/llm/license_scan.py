"""License scans by ordered signature rules over the words of whole texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices
from .license_rules import Rule, default_rules
from .words import words_of

SCHEMA = (
    "n_words long, detections array<struct<rule:string,label:string,first:long,last:long,score:double,base:boolean,kept:boolean>>"
)


class Scanner:
    """Rules compiled once per task, found by words of which every match of theirs holds one."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.by_key: dict[bytes, list[tuple[Rule, re.Pattern[bytes]]]] = {}
        for r in rules:
            # lookaround, so that places of one phrase may overlap
            pattern = rf"(?=(?<![^ ])({r.pattern})(?![^ ]))" if r.base else rf"(?<![^ ])(?:{r.pattern})(?![^ ])"
            for key in r.keyword.encode().split():
                self.by_key.setdefault(key, []).append((r, re.compile(pattern.encode())))
        self.keys = frozenset(self.by_key)

    def scan(self, words: list[bytes]) -> list[dict]:
        """All detections, in order of place; those suppressed have ``kept`` false."""
        keys = self.keys.intersection(words)
        if not keys:
            return []
        text = b" ".join(words)
        found = []
        tried = {rule: pattern for key in keys for rule, pattern in self.by_key[key]} if len(keys) > 1 else dict(self.by_key[next(iter(keys))])
        for rule, pattern in tried.items():
            for m in pattern.finditer(text):
                a, b = m.span(1) if rule.base else m.span("at") if "at" in pattern.groupindex else m.span()
                found.append((a, b, rule))
        return self._resolve(text, found)

    @staticmethod
    def _resolve(text: bytes, found: list[tuple[int, int, Rule]]) -> list[dict]:
        """Drop what lies inside a longer detection, then what overlaps one of a rule of higher priority.

        By start, then the longer first: a detection lies inside an earlier one exactly if
        one of those ends at or after its end, so one running maximum is enough; of equal
        extents the rule of higher priority stays.  What is left is taken by priority, each
        unless it overlaps what was taken before: that never overlaps itself, so only its
        neighbours have to be looked at.
        """
        found.sort(key=lambda x: (x[0], -x[1], x[2].priority))
        outer, reach = [], -1
        for k, (_, b, _) in enumerate(found):
            if b > reach:
                outer.append(k)
                reach = b
        taken: list[tuple[int, int, int]] = []
        for k in sorted(outer, key=lambda k: found[k][2].priority):
            a, b, _ = found[k]
            at = bisect_left(taken, (a, b, k))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                taken.insert(at, (a, b, k))
        kept = {k for _, _, k in taken}
        out, at, count = [], 0, 0
        for k, (a, b, rule) in enumerate(found):
            count += text.count(b" ", at, a)
            at = a
            out.append({"rule": rule.name, "label": rule.label, "first": count, "last": count + text.count(b" ", a, b), "score": rule.score, "base": rule.base, "kept": rule.base or k in kept})
        return out


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words`` and ``detections`` with places in words from 0.

    Texts are cut into words (see ``words``); null counts as empty; a rule is tried only on
    texts that hold one of its keywords.  ``kept`` is false for a detection inside a longer one, or
    that shares words with one of an earlier rule; base rules always keep theirs.  Texts of
    any length are read whole; repeated rows are reported each; an empty table gives no rows;
    no other column is read.
    """
    rules = tuple(default_rules() if rules is None else rules)
    out = docs.select(id_col, text_col)
    kind = out.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices(batches, 1, 8 << 20):
            counts, found = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                found.append(scanner.scan(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _DETECTIONS)], [id_col, "n_words", "detections"])

    return out.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


_DETECTIONS = pa.list_(
    pa.struct([("rule", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("base", pa.bool_()), ("kept", pa.bool_())])
)
