"""The cursor state: a small file that is replaced as a whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..paths import file_system, names_in, read_text, write_text


class CursorFile:
    """Positions by file. A save writes the next version beside the last and publishes it by a rename.

    A save that fails half-way leaves the last version in force.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        return sorted(int(n[6:-5]) for n in names_in(self.spark, self.path) if n.startswith("state-") and n.endswith(".json"))

    def load(self) -> dict[str, int]:
        versions = self._versions()
        return json.loads(read_text(self.spark, f"{self.path}/state-{versions[-1]}.json")) if versions else {}

    def save(self, positions: dict[str, int]) -> None:
        body = json.dumps(positions, sort_keys=True)  # fails before anything is written
        versions = self._versions()
        n = versions[-1] + 1 if versions else 0
        draft = f"{self.path}/draft-{n}.tmp"
        write_text(self.spark, draft, body)
        system, source = file_system(self.spark, draft)
        _, target = file_system(self.spark, f"{self.path}/state-{n}.json")
        if not system.rename(source, target):
            raise OSError(f"cursor state {n} could not be published")
        for old in versions[:-1]:
            system.delete(file_system(self.spark, f"{self.path}/state-{old}.json")[1], False)

    def advance(self, moved: dict[str, int]) -> dict[str, int]:
        """Move positions forward, never back."""
        held = self.load()
        now = held | {f: max(p, held.get(f, p)) for f, p in moved.items()}
        self.save(now)
        return now
