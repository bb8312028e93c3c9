"""Requests: decoding and normalising. Pure Python; a request is a value and never inherits from another."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

SLOTS = 6
LONGEST = 1000
PAGE = 100
ARRAYS = ("word", "lemma", "tags", "wildmatch", "wildmatch_lemma", "case", "dist_from", "dist_to")
SCALARS = ("return", "last_pos", "regex", "source", "source_field", "extend", "extend_range", "boundary", "count_only")


@dataclass(frozen=True)
class Slot:
    """Conditions on one token; all that are given must hold."""

    word: str = ""
    lemma: str = ""
    tags: str = ""
    wildmatch: str = ""
    wildmatch_lemma: str = ""
    case: bool = False

    @property
    def empty(self) -> bool:
        return not any((self.word, self.lemma, [t for t in self.tags.split(",") if t], self.wildmatch, self.wildmatch_lemma))


def clamp_distances(a: int, b: int) -> tuple[int, int]:
    """Both into 1..1000 (negative ones count as the largest), and in order."""
    one = lambda x: LONGEST if x < 0 or x > LONGEST else max(1, x)
    return tuple(sorted((one(a), one(b))))


@dataclass(frozen=True)
class CorpusQuery:
    slots: tuple[Slot, ...] = ()
    distances: tuple[tuple[int, int], ...] = ()
    returned: int = PAGE
    cursor: int = -1
    regex: bool = False
    source: str = ""
    source_field: str = "author"
    extend: int = -1
    extend_range: int = 0
    boundary: str = "strict"
    count_only: bool = False
    unknown: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def of(cls, *slots: Slot | dict, distances: list[tuple[int, int]] | None = None, **more) -> CorpusQuery:
        made = tuple(s if isinstance(s, Slot) else Slot(**s) for s in slots)
        return cls(made, tuple(distances or [(1, 1)] * (len(made) - 1)), **more).normalise()

    @classmethod
    def from_json(cls, text: str) -> CorpusQuery:
        got = json.loads(text)
        if not isinstance(got, dict):
            raise ValueError("a request is a JSON object")
        unknown = tuple(k for k in got if k not in ARRAYS and k not in SCALARS)
        lists = {k: list(got[k]) if isinstance(got.get(k), list) else [got[k]] if k in got else [] for k in ARRAYS}
        if any(len(v) > SLOTS for v in lists.values()):
            raise ValueError(f"at most {SLOTS} slots")
        at = lambda k, i, d: lists[k][i] if i < len(lists[k]) else d
        slots = tuple(Slot(*(str(at(k, i, "") or "") for k in ARRAYS[:5]), case=str(at("case", i, 0)) in ("1", "True", "true")) for i in range(SLOTS))
        distances = tuple((int(at("dist_from", i, 1) or 1), int(at("dist_to", i, 1) or 1)) for i in range(SLOTS - 1))
        number = lambda k, d: int(got[k]) if str(got.get(k, "")).strip().lstrip("-").isdigit() else d
        # a cursor may come as one number per thread, joined by x: here there is one
        cursor = max((int(x) for x in str(got.get("last_pos", "")).split("x") if x.strip().isdigit()), default=-1)
        return cls(
            slots, distances, number("return", PAGE), -1 if str(got.get("last_pos", "")).replace("0", "").replace("x", "") == "" else cursor, str(got.get("regex", 0)) in ("1", "True", "true"),
            str(got.get("source", "")), str(got.get("source_field", "author")), number("extend", -1), number("extend_range", 0), str(got.get("boundary", "strict")), str(got.get("count_only", 0)) in ("1", "True", "true"), unknown,
        ).normalise()

    def normalise(self) -> CorpusQuery:
        """Slots end at the last filled one; empty slots before it match any token. Numbers are clamped."""
        last = max((i for i, s in enumerate(self.slots) if not s.empty), default=-1) + 1
        if not last and self.extend < 0:
            raise ValueError("a request needs a condition")
        if last > SLOTS:
            raise ValueError(f"at most {SLOTS} slots")
        if self.boundary not in ("strict", "compat"):
            raise ValueError("boundary is strict or compat")
        distances = (*self.distances, *[(1, 1)] * last)[: max(0, last - 1)]
        return replace(
            self, slots=self.slots[:last], distances=tuple(clamp_distances(*d) for d in distances),
            returned=self.returned if 1 <= self.returned <= LONGEST else PAGE, extend=max(-1, self.extend),
            extend_range=self.extend_range if 0 <= self.extend_range < 10 else 2,
        )

    def alike(self) -> CorpusQuery:
        """The query without what only chooses a page: all pages of one search share it."""
        return replace(self, returned=PAGE, cursor=-1, extend=-1, extend_range=0, count_only=False, unknown=())

    @property
    def prefix(self) -> tuple[Slot, ...]:
        """The filled slots before the first gap: what an n-gram search looks at."""
        out = []
        for s in self.slots:
            if s.empty:
                break
            out.append(s)
        return tuple(out)
