"""Log-structured index of stored URLs: an insert check whose cost follows the batch, not the store.

Every batch adds one run, sorted by the hash of its URLs. Runs are merged in size classes, so there are few of them,
and a large one is cut by the leading bits of the hash into slices of at most ``SLICE_ROWS``. A small batch opens only
the slices its hashes fall into, and in these, since rows are sorted and the scan is given the hashes, only the row
groups and pages whose ranges and Bloom filters may hold one of them. A batch of more than ``LOOKUP`` URLs is joined
with all runs instead.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshots import Snapshots, by_tier

SCHEMA = "h long, url string"
#: Hashes of a batch that are sent along with the scan; above it, all runs are joined with the batch.
LOOKUP = 5_000
SLICE_ROWS = 500_000
FANOUT = 8
SMALLEST = 10_000


def url_hash() -> Column:
    """63 bits, not negative, so that its leading bits are slice numbers."""
    return F.shiftrightunsigned(F.xxhash64("url"), 1)


class UrlIndex:
    """Runs ``{"run", "rows", "bits"}`` of the table ``urls`` in a manifest's state."""

    def __init__(self, snapshots: Snapshots) -> None:
        self.snapshots = snapshots

    def known(self, state: dict[str, Any], candidates: DataFrame) -> DataFrame:
        """``url`` of the stored URLs among the candidates' (with few candidates), or of all (with many)."""
        runs = state["runs"].get("urls", [])
        asked = candidates.where("url IS NOT NULL").select(url_hash().alias("h")).distinct().limit(LOOKUP + 1).collect()
        if len(asked) > LOOKUP or not runs:
            return self._all(runs)
        hashes = [r["h"] for r in asked]
        found = self.snapshots.read(self.slices(runs, hashes), SCHEMA)
        return found.where(f"h IN ({','.join(map(str, hashes))})" if hashes else "false").select("url")

    def _all(self, runs: list[dict[str, Any]]) -> DataFrame:
        folders = [f"{r['run']}/tranche={i}" for r in runs for i in r["slices"]]
        return self.snapshots.read(folders, SCHEMA).select("url")

    @staticmethod
    def slices(runs: list[dict[str, Any]], hashes: list[int]) -> list[str]:
        """The folders that may hold one of the hashes."""
        return [f"{r['run']}/tranche={i}" for r in runs for i in sorted({h >> 63 - r["bits"] for h in hashes} & set(r["slices"]))]

    def add(self, state: dict[str, Any], urls: DataFrame, rows: int) -> None:
        """Puts ``urls`` (new ones, ``rows`` of them) into the state as a run; merges what is due."""
        runs = state["runs"].setdefault("urls", [])
        if rows:
            runs.append(self._write(urls.select("url"), rows))
        while due := by_tier(runs, FANOUT, SMALLEST):
            merged = self._write(self._all(due), sum(r["rows"] for r in due))
            runs[:] = [r for r in runs if r not in due] + [merged]
            self.snapshots.drop(state, [r["run"] for r in due])

    def _write(self, urls: DataFrame, rows: int) -> dict[str, Any]:
        bits = max(0, -(-rows // SLICE_ROWS) - 1).bit_length()
        placed = urls.select(url_hash().alias("h"), "url").withColumn("tranche", F.shiftright("h", 63 - bits).cast("int"))
        sorted_ = placed.repartition(1 << bits, "tranche").sortWithinPartitions("tranche", "h")
        bloom = {"parquet.bloom.filter.enabled#h": "true", "parquet.bloom.filter.expected.ndv#h": str(min(rows, SLICE_ROWS))}
        run = self.snapshots.write("urls", sorted_, by="tranche", **bloom)
        folders = self.snapshots.files.names(f"{self.snapshots.root}/{run}")
        return {"run": run, "rows": rows, "bits": bits, "slices": [int(n.split("=")[1]) for n in folders if "=" in n]}
