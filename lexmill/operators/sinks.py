"""Sinks: JSONL with nulls, summaries, and published folders that appear whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """K1."""
    rows.write.option("ignoreNullFields", "false").json(path)


def write_summary(row: DataFrame, path: str) -> None:
    """K2: the one row of an aggregate, as indented JSON."""
    one = row.first().asDict(recursive=True)
    Path(path).write_text(json.dumps(one, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_summary_csv(row: DataFrame, path: str) -> None:
    """K3."""
    row.limit(1).coalesce(1).write.option("header", True).csv(path)


def canonical_json(rows: DataFrame) -> DataFrame:
    """One line a row: sorted keys, compact, nulls kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def publish(parts: dict[str, tuple[DataFrame, list[str]]], folder: str, manifest: dict) -> dict[str, str]:
    """K4, K5: each part as canonical JSONL in its order, a manifest and checksums, staged beside and renamed.

    For local or mounted folders. An existing target is refused; a failed build leaves nothing.
    """
    target = Path(folder)
    if target.exists():
        raise FileExistsError(folder)
    stage = target.with_name(target.name + ".staging")
    shutil.rmtree(stage, ignore_errors=True)
    stage.mkdir(parents=True)
    try:
        sums = {}
        for name, (rows, order) in parts.items():
            digest = hashlib.sha256()
            with open(stage / name, "wb") as out:
                for r in canonical_json(rows.orderBy(*order)).toLocalIterator():
                    line = r["value"].encode() + b"\n"
                    digest.update(line)
                    out.write(line)
            sums[name] = digest.hexdigest()
        text = json.dumps(manifest, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
        (stage / "manifest.json").write_text(text, encoding="utf-8")
        sums["manifest.json"] = hashlib.sha256(text.encode()).hexdigest()
        (stage / "checksums.json").write_text(json.dumps(sums, sort_keys=True, indent=2) + "\n", encoding="utf-8")
        os.rename(stage, target)
        return sums
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def verify(folder: str) -> list[str]:
    """Names whose content or presence differs from the checksums."""
    root = Path(folder)
    sums = json.loads((root / "checksums.json").read_text(encoding="utf-8"))
    here = {p.name for p in root.iterdir()} - {"checksums.json"}
    bad = [n for n in sums if n in here and hashlib.sha256((root / n).read_bytes()).hexdigest() != sums[n]]
    return sorted({*bad, *(here ^ sums.keys())})
