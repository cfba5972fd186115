"""Operators: selections, pairs, histograms, random reference, finalisation and derived results."""
