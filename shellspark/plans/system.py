"""What a calculation runs on: solute and solvent atoms by frame, and the frames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options


@dataclass
class System:
    """solute: frame, smol, sidx, satype, satom, sx, sy, sz; solvent: frame, vmol, vidx, vatype, vatom, vx, vy, vz;
    frames: frame, w, m (cell), volume.  sidx and vidx number a frame's molecules from 1.

    n_solute and n_solvent are molecules per frame; groups: side, group_id, group_name, atom (or atype, by default).
    """

    solute: DataFrame
    solvent: DataFrame
    frames: DataFrame
    n_solute: float
    n_solvent: float
    solute_atoms: int
    solvent_atoms: int
    options: Options
    irefatom: int
    ortho: bool = True
    autocorrelation: bool = False
    groups: DataFrame | None = None
    files: tuple = ()

    @property
    def solvent_nmols(self) -> float:
        """Solvent molecules that one solute molecule can meet."""
        return self.n_solvent - 1 if self.autocorrelation else self.n_solvent

    def considered(self) -> DataFrame:
        """Frames first:stride:last whose weight is not zero."""
        o = self.options
        last = F.lit(True) if o.lastframe < 0 else F.col("frame") <= o.lastframe
        return self.frames.where((F.col("frame") >= o.firstframe) & last & (F.pmod(F.col("frame") - o.firstframe, F.lit(o.stride)) == 0) & (F.col("w") != 0))

    def pruned(self) -> System:
        """The system over the considered frames only; on a trajectory that is partitioned by frame the scan is pruned."""
        frames = self.considered()
        o = self.options
        cut = lambda df: df.where((F.col("frame") >= o.firstframe) & (F.lit(True) if o.lastframe < 0 else F.col("frame") <= o.lastframe) & (F.pmod(F.col("frame") - o.firstframe, F.lit(o.stride)) == 0))
        return replace(self, frames=frames, solute=cut(self.solute), solvent=cut(self.solvent))

    def weight(self) -> tuple[float, float, int]:
        """Q (the sum of frame weights), the mean volume and the number of frames."""
        r = self.considered().agg(F.sum("w").alias("q"), F.sum(F.col("w") * F.col("volume")).alias("v"), F.count(F.lit(1)).alias("n")).first()
        if not r.q or r.q <= 0:
            raise ValueError("the weights of the considered frames must have a positive sum")
        return r.q, r.v / r.q, r.n
