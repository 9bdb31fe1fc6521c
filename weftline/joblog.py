"""What is known of each job, in a folder that outlives the driver: one small JSON file a job."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any


class JobLog:
    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def put(self, job_id: str, state: dict[str, Any]) -> None:
        """Replace what is logged of a job, all at once."""
        new = self.folder / f".{job_id}.tmp"
        new.write_text(json.dumps(state))
        os.replace(new, self.folder / f"{job_id}.json")

    def get(self, job_id: str) -> dict[str, Any]:
        path = self.folder / f"{job_id}.json"
        if not path.is_file() or path.parent != self.folder:
            raise KeyError(f"no job {job_id}")
        return json.loads(path.read_text())

    def all(self) -> list[dict[str, Any]]:
        return [json.loads(p.read_text()) for p in sorted(self.folder.glob("*.json"))]
