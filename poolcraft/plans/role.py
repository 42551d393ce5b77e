"""What a pool is screened for: a checked set of parameters, and the work that waits for a judge."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolcraft.operators import judged, ranking, state


@dataclass(frozen=True)
class Role:
    """``criteria``: greatest score per criterion; ``version`` of the rules, which stored results depend on."""

    title: str
    version: int
    criteria: dict[str, float]
    fraction: float
    delta: float = 5.0
    window: int = 5
    bonus_max: float = 5.0
    preferred: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.criteria or any(top <= 0 for top in self.criteria.values()):
            raise ValueError("criteria: at least one, each with a positive greatest score")
        if abs(sum(self.criteria.values()) - 100) > 1e-9:
            raise ValueError(f"criteria: greatest scores must sum to 100, not {sum(self.criteria.values())}")
        if not 0 < self.fraction <= 1:
            raise ValueError("fraction: above 0, at most 1")
        if self.window < 0 or self.delta < 0 or self.bonus_max < 0:
            raise ValueError("window, delta and bonus_max: not below 0")

    @classmethod
    def read(cls, source: str | Path | dict) -> Role:
        """From a mapping or a JSON file; missing and unknown keys, and a criterion given twice, are errors."""
        raw = dict(source) if isinstance(source, dict) else json.loads(Path(source).read_text(), object_pairs_hook=_once)
        known = {f.name for f in fields(cls)}
        needed = {"title", "version", "criteria", "fraction"}
        if wrong := sorted(needed - set(raw)) or sorted(set(raw) - known):
            raise ValueError(f"keys missing or unknown: {', '.join(wrong)}")
        return cls(**{**raw, "criteria": {k: float(v) for k, v in raw["criteria"].items()}, "preferred": tuple(raw.get("preferred", ()))})

    def order(self, score: str = "final", tie: str | None = None) -> ranking.Order:
        return ranking.Order(score, tie, self.preferred) if tie else ranking.Order(score)


def _once(pairs: list[tuple[str, object]]) -> dict:
    keys = [k for k, _ in pairs]
    if twice := sorted({k for k in keys if keys.count(k) > 1}):
        raise ValueError(f"given twice: {', '.join(twice)}")
    return dict(pairs)


def waiting(texts: DataFrame, stored: DataFrame, role: Role, template: str) -> DataFrame:
    """(id, digest, prompt) of the ``texts`` (id, text) that no stored result (id, digest) of the same text and rules covers.

    ``template`` holds ``{title}``, ``{criteria}`` and ``{text}``; braces in a text are left alone. Null texts have nothing to judge and are left out; repeated rows are asked for repeatedly.
    """
    listed = "\n".join(f"- {name} (0 to {top:g})" for name, top in sorted(role.criteria.items()))
    before, _, after = template.replace("{title}", role.title).replace("{criteria}", listed).partition("{text}")
    digest = judged.digest(F.col("text"), F.lit(f"rules {role.version}"))
    held = texts.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text", digest.alias("digest"))
    todo = state.pending(held.select("id", "digest"), stored.select("id", "digest")).select("id", "digest").distinct()
    return held.join(todo, ["id", "digest"], "left_semi").select("id", "digest", F.concat(F.lit(before), "text", F.lit(after)).alias("prompt"))
