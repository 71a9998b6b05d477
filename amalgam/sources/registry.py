"""Registry of ingested batches: contiguous ranges of record numbers, duplicates refused by content."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from ..storage import read_text, write_text


@dataclass(frozen=True)
class Batch:
    batch_id: str
    file: str
    rows: int
    start_index: int
    end_index: int
    sha256: str

    @property
    def record_id_range(self) -> tuple[str, str]:
        return f"rec_{self.start_index + 1:06d}", f"rec_{self.end_index:06d}"


class Registry:
    def __init__(self, path: str) -> None:
        self.path = path
        self.batches = [Batch(**b) for b in json.loads(read_text(path) or "[]")]

    def next_start(self) -> int:
        """After the greatest index ever given, so removing a batch in the middle can't bring ids back."""
        return max((b.end_index for b in self.batches), default=0)

    def register(self, file: str, rows: int, sha256: str) -> Batch:
        if any(b.sha256 == sha256 for b in self.batches):
            raise ValueError(f"{file} is registered already")
        start = self.next_start()
        batch = Batch(f"batch_{len(self.batches) + 1:04d}", file, rows, start, start + rows, sha256)
        self.batches.append(batch)
        self._save()
        return batch

    def unregister(self, file: str) -> None:
        self.batches = [b for b in self.batches if b.file != file]
        self._save()

    def problems(self, stored_rows: int) -> list[str]:
        """Gaps between batches, and a count that is not that of the stored table."""
        out = [f"gap before {b.batch_id}" for a, b in zip(self.batches, self.batches[1:], strict=False) if b.start_index != a.end_index]
        total = sum(b.rows for b in self.batches)
        return out + [f"{total} rows are registered, {stored_rows} stored"] * (total != stored_rows)

    def _save(self) -> None:
        write_text(self.path, json.dumps([asdict(b) for b in self.batches], indent=2))
