"""Settings of comparisons, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    refdist: int = 500
    pctseq: float = 0.70
    pctsize: float = 0.70
    pctovl: float = 0.0
    typeignore: bool = False
    no_roll: bool = False
    chunksize: int = 1000
    bnddist: int = 100
    sizemin: int = 50
    sizefilt: int | None = None
    sizemax: int = 50_000
    max_resolve: int = 25_000
    passonly: bool = False
    no_ref: str | None = None
    pick: str = "single"
    ignore_monref: bool = True
    check_multi: bool = True
    check_monref: bool = True
    no_single_bnd: bool = True
    write_resolved: bool = False
    decompose: bool = True
    dup_to_ins: bool = False
    short_circuit: bool = False
    skip_gt: bool = False
    max_chunk: int | None = None
    bsample: str | None = None
    csample: str | None = None
    dynthresh: tuple[int, int, int | None, int | None] | None = None

    def __post_init__(self):
        if self.chunksize < self.refdist:
            raise ValueError("chunksize must be at least refdist")
        for name in ("pctseq", "pctsize", "pctovl"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.pick not in ("single", "ac", "multi"):
            raise ValueError(f"unknown pick: {self.pick}")
        if self.no_ref not in (None, "a", "b", "c"):
            raise ValueError(f"unknown no_ref: {self.no_ref}")
        if self.sizefilt is None:
            object.__setattr__(self, "sizefilt", min(self.sizemin, 30))

    @classmethod
    def of(cls, args: object = None, **given) -> Params:
        """From the attributes of ``args`` that are settings, then from keywords; an unknown keyword is an error."""
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        found = {k: getattr(args, k) for k in known if hasattr(args, k)} if args is not None else {}
        return cls(**found | given)

    def but(self, **changes) -> Params:
        return replace(self, **changes)

    def dynamic_threshold(self, size: float) -> float:
        low, high, s_min, s_max = self.dynthresh
        s_min = 2 * low if s_min is None else s_min
        s_max = 2 * high if s_max is None else s_max
        part = min(max((size - s_min) / (s_max - s_min), 0.0), 1.0)
        return 1 - (low + part * (high - low)) / size
