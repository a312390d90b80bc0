"""Runs of ordered stages: configuration with all its errors at once, stage reports, resuming. Driver-side bookkeeping; the data stay in Spark."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

STATUSES = ("success", "rejected", "empty", "failed")


@dataclass(frozen=True)
class SmoothingConfig:
    min_confidence: float = 0.2
    max_gap_frames: int = 4
    max_displacement: float = 80.0
    window: int = 5
    alpha: float = 0.35


@dataclass(frozen=True)
class EventConfig:
    hit_distance: float = 80.0
    turn_angle: float = 100.0
    min_gap_frames: int = 15


@dataclass(frozen=True)
class SegmentConfig:
    sample_every: int = 30
    threshold: float = 0.75
    min_seconds: float = 3.0
    max_gap_seconds: float = 2.0


@dataclass(frozen=True)
class Config:
    smoothing: SmoothingConfig = field(default_factory=SmoothingConfig)
    events: EventConfig = field(default_factory=EventConfig)
    segments: SegmentConfig = field(default_factory=SegmentConfig)


#: (section, name): the least and the greatest value allowed.
RANGES = {
    ("smoothing", "min_confidence"): (0, 1), ("smoothing", "max_gap_frames"): (0, 1000), ("smoothing", "alpha"): (0, 1), ("smoothing", "window"): (1, 999), ("smoothing", "max_displacement"): (0, 1e6),
    ("events", "turn_angle"): (0, 180), ("events", "min_gap_frames"): (0, 1_000_000), ("events", "hit_distance"): (0, 1e6), ("segments", "sample_every"): (1, 100_000), ("segments", "threshold"): (0, 1),
}


def merged(*layers: dict) -> dict:
    """Later layers over earlier ones, section by section."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(values: dict, kind: type = Config) -> Config:
    """A Config from plain values, or ValueError with every unknown name, wrong type and value out of range. Integers pass as floats, booleans as neither."""
    errors: list[str] = []

    def build(kind: type, values: object, path: str):
        if not isinstance(values, dict):
            errors.append(f"{path or 'config'}: a section is needed")
            return kind()
        known, given = {f.name: f for f in fields(kind)}, {}
        errors.extend(f"{path}{k}: unknown" for k in values if k not in known)
        for name, value in values.items():
            if name not in known:
                continue
            default = getattr(kind(), name)
            if is_dataclass(default):
                given[name] = build(type(default), value, f"{path}{name}.")
            elif isinstance(value, bool) or not isinstance(value, (int, float) if isinstance(default, float) else type(default)):
                errors.append(f"{path}{name}: {type(default).__name__} is needed")
            else:
                low, high = RANGES.get((path.rstrip("."), name), (float("-inf"), float("inf")))
                if not low <= value <= high:
                    errors.append(f"{path}{name}: {value} is not in [{low}, {high}]")
                given[name] = float(value) if isinstance(default, float) else value
        return kind(**given)

    made = build(kind, values, "")
    if errors:
        raise ValueError("; ".join(errors))
    return made


@dataclass
class StageReport:
    stage: str
    order: int
    status: str = "failed"
    detail: str = ""
    rows: int | None = None
    started: str = ""
    ended: str = ""


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


@dataclass
class Run:
    """A run's identity and its stage reports, in order."""

    run_id: str
    source: str
    config: Config
    reports: list[StageReport] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str):
        """Reports success unless the body sets another status; an error is reported and raised."""
        report = StageReport(name, len(self.reports), "success", started=_now())
        self.reports.append(report)
        try:
            yield report
        except Exception as e:
            report.status, report.detail = "failed", f"{type(e).__name__}: {e}"[:500]
            raise
        finally:
            report.ended = _now()

    def manifest(self) -> str:
        return json.dumps({"run_id": self.run_id, "source": self.source, "config": asdict(self.config), "stages": [asdict(r) for r in self.reports]}, ensure_ascii=False, indent=2)

    def resumed(self, manifest: str) -> int:
        """How many stages of an earlier run stand: its longest run of successes from the start. Source and configuration must be the same."""
        old = json.loads(manifest)
        if old["source"] != self.source or old["config"] != asdict(self.config):
            raise ValueError("the earlier run had another source or configuration")
        self.reports = []
        for r in old["stages"]:
            if r["status"] != "success":
                break
            self.reports.append(StageReport(**r))
        return len(self.reports)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.run_id, r.order, r.stage, r.status, r.detail, r.rows, r.started, r.ended) for r in self.reports]
        return spark.createDataFrame(rows, "run_id string, stage_order int, stage string, status string, detail string, rows bigint, started string, ended string")


def run_stages(run: Run, df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], write: Callable[[str, DataFrame], DataFrame], stop_after: str | None = None) -> DataFrame:
    """Apply stages in order, each written by `write`, which gives back what to go on with; stages that `resumed` kept are read by it from before.

    A stage without rows is reported empty and ends the run.
    """
    names = [n for n, _ in stages]
    if stop_after is not None and stop_after not in names:
        raise ValueError(f"unknown stage {stop_after}")
    done = [r.stage for r in run.reports]
    if done != names[: len(done)]:
        raise ValueError("stages can't change their order between runs")
    for name, f in stages:
        if name in done:
            df = write(name, None)
        else:
            with run.stage(name) as report:
                df = write(name, f(df))
                report.rows = df.count()
                if not report.rows:
                    report.status = "empty"
        if name == stop_after or run.reports[-1].status == "empty":
            break
    return df
