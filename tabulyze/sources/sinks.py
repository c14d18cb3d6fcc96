"""Writing findings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(frames: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "error") -> list[str]:
    """Write each finding frame to its own folder; returns the paths."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported report format {fmt!r}")
    paths = []
    for name, frame in frames.items():
        path = f"{folder.rstrip('/')}/{name}"
        frame.write.mode(mode).format(fmt).save(path)
        paths.append(path)
    return paths
