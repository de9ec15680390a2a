"""The list of a store's runs, versioned; the file with the highest number is the store's state."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from tidemark.model import ConflictError
from tidemark.operators.compact import Run
from tidemark.sources.files import Files

FOLDER = "manifest"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    max_seq: int = 0
    next_gen: int = 1
    max_levels: int = 7
    runs: tuple[Run, ...] = ()
    #: Of each stream, the last batch that was committed.
    batches: dict[str, int] = field(default_factory=dict)

    def encode(self) -> bytes:
        out = asdict(self)
        out["runs"] = [asdict(r) | {"min_key": r.min_key.hex(), "max_key": r.max_key.hex()} for r in self.runs]
        return json.dumps(out).encode()

    @staticmethod
    def decode(data: bytes) -> Manifest:
        raw = json.loads(data)
        raw["runs"] = tuple(Run(**(r | {"min_key": bytes.fromhex(r["min_key"]), "max_key": bytes.fromhex(r["max_key"]), "files": tuple(map(tuple, r.get("files", ())))})) for r in raw["runs"])
        return Manifest(**raw)


def load(files: Files) -> Manifest | None:
    names = [n for n in files.names(FOLDER) if n.endswith(".json") and n[:-5].isdigit()]
    return Manifest.decode(files.read(f"{FOLDER}/{names[-1]}")) if names else None


def commit(files: Files, manifest: Manifest) -> Manifest:
    """Publish the next version; ConflictError if another writer took its number."""
    new = replace(manifest, version=manifest.version + 1)
    if not files.create(f"{FOLDER}/{new.version:020d}.json", new.encode()):
        raise ConflictError(f"version {new.version} exists")
    return new


def expire(files: Files, keep: int) -> None:
    """Delete old versions but for the last ``keep``."""
    for name in [n for n in files.names(FOLDER) if n.endswith(".json")][:-keep]:
        files.delete(f"{FOLDER}/{name}")
