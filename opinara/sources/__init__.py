"""Readers and writers: survey exports, codebooks, snapshots and posterior draws."""

from .draws import read_draws
from .export import read_codebook, read_export, write_csv
from .snapshot import read_snapshot, write_snapshot

__all__ = ["read_codebook", "read_draws", "read_export", "read_snapshot", "write_csv",
           "write_snapshot"]
