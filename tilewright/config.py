"""Settings of the engine, with their ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: The range of each number.
RANGES = {"quality": (0, 7), "near": (0, 64), "budget_mb": (256, 16384)}
#: A change of one of these makes cached results useless.
RELOAD = ("cache_folder", "quality")


@dataclass(frozen=True)
class Config:
    quality: int = 4
    near: int = 6
    budget_mb: int = 2048
    forced_budget_mb: int | None = None
    cache_folder: str = ""
    disabled: bool = False
    debug: bool = False

    def __post_init__(self):
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be {low} to {high}")

    @classmethod
    def of(cls, spark, prefix: str = "spark.tilewright.") -> Config:
        """From the session's settings; what is not set has its default."""
        out = cls()
        for f in fields(cls):
            text = spark.conf.get(prefix + f.name, None)
            if text is not None:
                kind = str(f.type)
                value = text.lower() == "true" if "bool" in kind else int(text) if "int" in kind else text
                out = replace(out, **{f.name: value})
        return out

    def needs_reload(self, other: Config) -> bool:
        return any(getattr(self, n) != getattr(other, n) for n in RELOAD)


def info() -> dict:
    """What this engine encodes with."""
    return {"backend": "numpy", "native": False, "formats": ("BC1", "BC7"), "modes": (4, 5, 6)}
