"""Options of a calculation, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Version of the formats that results are saved in.
VERSION = "3.0.0"


@dataclass(frozen=True)
class Options:
    """dbulk: where the bulk begins; cutoff: where counting ends; with ``usecutoff`` the bulk is what lies between.

    Without any of the three, both are 10 and the bulk is all that lies beyond.  ``lcell``: cells of the range join are
    cutoff / lcell wide.  ``nthreads``, ``GC``, ``GC_threshold``, ``StableRNG`` and ``low_memory`` are taken for compatibility; Spark decides on parallelism and memory.
    """

    firstframe: int = 1
    lastframe: int = -1
    stride: int = 1
    irefatom: int = -1
    n_random_samples: int = 10
    binstep: float = 0.02
    dbulk: float | None = None
    cutoff: float | None = None
    usecutoff: bool | None = None
    bulk_range: tuple[float, float] | None = None
    seed: int = 321
    silent: bool = False
    lcell: int = 1
    nthreads: int = 0
    GC: bool = True
    GC_threshold: float = 0.3
    StableRNG: bool = False
    low_memory: bool = False
    _: None = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.stride < 1:
            raise ValueError("stride must be at least 1")
        if 0 < self.lastframe < self.firstframe:
            raise ValueError("lastframe must not be smaller than firstframe")
        if self.n_random_samples < 1:
            raise ValueError("n_random_samples must be at least 1")
        put = lambda k, v: object.__setattr__(self, k, v)
        if self.bulk_range is not None:
            if self.dbulk is not None or self.cutoff is not None or self.usecutoff is not None:
                raise ValueError("bulk_range excludes dbulk, cutoff and usecutoff")
            if len(self.bulk_range) != 2:
                raise ValueError("bulk_range needs two distances")
            put("dbulk", float(self.bulk_range[0]))
            put("cutoff", float(self.bulk_range[1]))
            put("usecutoff", True)
        elif self.usecutoff:
            put("dbulk", 10.0 if self.dbulk is None else float(self.dbulk))
            put("cutoff", self.dbulk + 4.0 if self.cutoff is None else float(self.cutoff))
        else:
            if self.cutoff is not None:
                raise ValueError("a cutoff needs usecutoff=True, or bulk_range")
            put("dbulk", 10.0 if self.dbulk is None else float(self.dbulk))
            put("cutoff", self.dbulk)
            put("usecutoff", False)
        if self.usecutoff and self.dbulk >= self.cutoff:
            raise ValueError("the bulk region between dbulk and cutoff is empty")
        for name in ("cutoff", "dbulk"):
            ratio = getattr(self, name) / self.binstep
            if abs(ratio - round(ratio)) > 1e-5:
                raise ValueError(f"{name} must be a multiple of binstep")

    def bin(self, distance: float) -> int:
        """The histogram bin of a distance, from 1."""
        return max(1, math.ceil(distance / self.binstep - 1e-9))

    @property
    def nbins(self) -> int:
        return self.bin(self.cutoff)

    @property
    def ibulk(self) -> int:
        """First bin of the bulk."""
        return max(1, math.ceil((self.dbulk + self.binstep / 2) / self.binstep))

    @property
    def radius(self) -> float:
        """How far pairs are searched."""
        return self.cutoff if self.usecutoff else self.dbulk

    def __str__(self) -> str:
        bulk = f"{self.dbulk} - {self.cutoff} A" if self.usecutoff else f">= {self.dbulk} A"
        last = "last" if self.lastframe < 0 else self.lastframe
        rows = [
            ("Frames", f"{self.firstframe} to {last}, every {self.stride}"),
            ("Bulk region", bulk),
            ("Bin step", f"{self.binstep} A, {self.nbins} bins"),
            ("Reference atom of the solvent", "the closest to its centre" if self.irefatom < 0 else self.irefatom),
            ("Random samples of each frame", self.n_random_samples),
            ("Seed", self.seed),
            ("Silent", self.silent),
        ]
        return "Options\n" + "\n".join(f"  {k}: {v}" for k, v in rows)
