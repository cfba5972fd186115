"""Incremental counts over trajectories that arrive as a stream of frames."""
