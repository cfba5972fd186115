"""Sinks: text reports, PDB files and saved results."""
