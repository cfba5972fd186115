"""Sources: PDB, DCD, parquet trajectories and trajectories made of relational tables."""
