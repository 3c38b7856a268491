"""Failures with a code and a stage, the settings, and what turns findings into an exit code."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

CODES = ("invalid_input", "rules_unavailable", "matcher_failed", "timeout", "dependency_failed", "graph_failed", "output_failed", "internal")
STAGES = ("setup", "rules", "detect", "dependencies", "graph", "export")
RETRYABLE = frozenset({"timeout", "rules_unavailable"})


class Failure(Exception):
    """An error that callers can act on: ``payload`` is its JSON form."""

    def __init__(self, code: str, stage: str, message: str, retryable: bool | None = None, **details: object):
        if code not in CODES or stage not in STAGES:
            raise ValueError(f"unknown code or stage: {code}, {stage}")
        super().__init__(message)
        self.code, self.stage, self.details = code, stage, details
        self.retryable = code in RETRYABLE if retryable is None else retryable

    @property
    def payload(self) -> str:
        return json.dumps({"error": {"code": self.code, "stage": self.stage, "message": str(self), "retryable": self.retryable, "details": self.details}}, sort_keys=True, default=str)


def matcher_failure(code: int, errors: list[dict], stderr: str, seconds: float) -> Failure | None:
    """What an external matcher's end means: 0 and 1 are fine, and so is 2 if only some rules did not apply."""
    if code in (0, 1):
        return None
    if code == 2 and errors and all(e.get("level") == "warn" or "rule" in str(e.get("type", "")).lower() for e in errors):
        return None
    clean = re.sub(r"(?i)(token|password|secret)(\s*[=:]\s*)\S+", r"\1\2***", re.sub(r"\x1b\[[0-9;]*m", "", stderr)).strip()[-500:]
    kind = "timeout" if code in (124, 137) else "matcher_failed"
    return Failure(kind, "detect", f"matcher ended with {code}", exit_code=code, stderr=clean, seconds=round(seconds, 3))


@dataclass
class Settings:
    """Settings from a file, the environment, then overrides; later ones win."""

    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None, **overrides: str | None) -> Settings:
        values: dict[str, str] = {}
        if path and Path(path).exists():
            values |= {str(k): str(v) for k, v in json.loads(Path(path).read_text(encoding="utf-8") or "{}").items()}
        for name, value in (os.environ if environment is None else environment).items():
            if name.startswith("TRACEWELL_"):
                values[name.removeprefix("TRACEWELL_").lower()] = value
        return cls(values | {k: v for k, v in overrides.items() if v is not None})

    def save(self, path: str) -> None:
        """Write the settings for the owner's eyes only."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as out:
            json.dump(self.values, out, indent=2, sort_keys=True)
        os.chmod(path, 0o600)


def java_runtime(requested: str, homes: dict[str, str]) -> tuple[int, str, str]:
    """(major, home, cache token) of a requested Java: 8, 1.8, 11 ...; empty takes the newest home."""
    majors = {int(re.sub(r"^1\.", "", m).split(".")[0]): h for m, h in homes.items()}
    if not majors:
        raise Failure("invalid_input", "setup", "no Java home is known")
    found = re.fullmatch(r"(?:1\.)?(\d+)(?:[.\d_]*)?", requested.strip()) if requested.strip() else None
    if requested.strip() and not found:
        raise Failure("invalid_input", "setup", f"not a Java version: {requested!r}")
    major = int(found[1]) if found else max(majors)
    if major not in majors:
        raise Failure("invalid_input", "setup", f"no home for Java {major}", known=sorted(majors))
    return major, majors[major], f"jdk{major}"


def check_options(target: str, output: str, formats: tuple[str, ...] = ("json", "cyclonedx", "jsonl"), max_frames: int = 32) -> None:
    """Raise Failure for options that can't be."""
    if not target:
        raise Failure("invalid_input", "setup", "no target")
    if output not in formats:
        raise Failure("invalid_input", "setup", f"unknown format {output!r}", known=list(formats))
    if max_frames < 1:
        raise Failure("invalid_input", "setup", "max_frames must be 1 or more")


def exit_code(n_findings: int, fail_on_findings: bool) -> int:
    return int(fail_on_findings and n_findings > 0)
