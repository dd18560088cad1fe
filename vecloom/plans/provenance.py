"""Records of where and how every stage of a computation ran."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "vecloom-stage/1"
REQUESTS = ("auto", "driver", "executors", "fixed", "inherited")
PLACES = ("driver", "executors")


class ProvenanceError(ValueError):
    """A record that contradicts its schema or its stages."""

    def __init__(self, message: str, expected: object, actual: object):
        super().__init__(message)
        self.expected, self.actual = expected, actual


@dataclass(frozen=True)
class Stage:
    """One stage: what was asked for, where it ran, by which strategy and why, and where its output is."""

    requested_device: str
    device: str
    backend: str
    selection_reason: str
    fallback: bool = False
    output_device: str | None = None

    def __post_init__(self):
        if self.output_device is None:
            object.__setattr__(self, "output_device", self.device)
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name != "fallback" and (not isinstance(value, str) or not value):
                raise ValueError(f"A stage names its `{f.name}` in a text that isn't empty.")
        if self.requested_device not in REQUESTS:
            raise ValueError(f"`requested_device` must be one of {', '.join(REQUESTS)}.")
        for name in ("device", "output_device"):
            if getattr(self, name) not in PLACES:
                raise ValueError(f"`{name}` must be one of {', '.join(PLACES)}.")
        if not isinstance(self.fallback, bool):
            raise ValueError("`fallback` is True or False.")
        if self.fallback and (self.requested_device, self.device) != ("auto", "driver"):
            raise ValueError("`fallback` is only legal when an automatic request ended on the driver.")


def stage(device: str = "executors", backend: str = "sql", reason: str = "default", requested: str = "auto", fallback: bool = False, output: str | None = None) -> Stage:
    return Stage(requested, device, backend, reason, fallback, output)


def compute_device(stages: dict[str, Stage]) -> str:
    """The one place where all stages ran, or "hybrid"."""
    _checked(stages)
    found = {s.device for s in stages.values()}
    return found.pop() if len(found) == 1 else "hybrid"


def _checked(stages: object) -> dict[str, Stage]:
    if not isinstance(stages, dict) or not stages or not all(isinstance(k, str) and k and isinstance(s, Stage) for k, s in stages.items()):
        raise ValueError("Stages must be a non-empty mapping of names to stage records.")
    return stages


def provenance(x: object) -> list[dict]:
    """One record for each stage of a result, or of a bare mapping of stages."""
    declared = getattr(x, "provenance_schema", SCHEMA)
    if declared != SCHEMA:
        raise ProvenanceError(f"Unsupported provenance schema; expected {SCHEMA}.", SCHEMA, declared)
    stages = x if isinstance(x, dict) else getattr(x, "stages", None)
    if stages is None:
        raise ValueError("The object does not contain compute-stage provenance.")
    actual = compute_device(stages)
    told = getattr(x, "compute_device", actual)
    if told != actual:
        raise ProvenanceError("The declared compute device does not match the recorded stages.", actual, told)
    names = [f.name for f in fields(Stage)]
    return [{"stage": name, **dict(zip(names, astuple(s)))} for name, s in stages.items()]


def provenance_frame(spark: SparkSession, x: object) -> DataFrame:
    rows = [tuple(r.values()) for r in provenance(x)]
    return spark.createDataFrame(rows, "stage string, requested_device string, device string, backend string, selection_reason string, fallback boolean, output_device string")
