"""Saved statements: a JSON file of named scripts with their default variables."""

from __future__ import annotations

import json
import os
from pathlib import Path

from quillframe.errors import AnalysisError
from quillframe.plans.parser import parse
from quillframe.plans.session import Result, Session


class SavedQueries:
    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> dict[str, dict]:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}

    def _write(self, entries: dict[str, dict]) -> None:
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(entries, ensure_ascii=False, indent=1), encoding="utf-8")
        os.replace(part, self.path)

    def save(self, name: str, sql: str, variables: dict | None = None, description: str = "") -> None:
        """Add or replace; the text must parse."""
        parse(sql)
        self._write(self.all() | {name: {"sql": sql, "variables": variables or {}, "description": description}})

    def get(self, name: str) -> dict:
        entries = self.all()
        if name not in entries:
            raise AnalysisError(f"no saved query {name}")
        return entries[name]

    def delete(self, name: str) -> None:
        self.get(name)
        entries = self.all()
        del entries[name]
        self._write(entries)

    def run(self, name: str, session: Session, variables: dict | None = None) -> list[Result]:
        entry = self.get(name)
        session.given |= entry["variables"] | (variables or {})
        return session.run(entry["sql"])
