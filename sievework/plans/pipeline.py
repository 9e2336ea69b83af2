"""Pipelines: definitions, checks, and running them as one lazy DataFrame graph."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from .builtin import BUILTIN

FAN_OUT_PATHS = ("$", "$.many", "$.documents")
SINK = "index_sink"


class PipelineError(ValueError):
    """kind: Empty, InvalidUid, DuplicateStep, UnknownDependency, Cycle, FanOutArity, FanOutPath, PruneWithFanOut."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"invalid pipeline {kind}: {detail}")
        self.kind = kind


@dataclass
class Step:
    id: str
    plugin: str
    depends_on: list[str] = field(default_factory=list)
    fan_out: str | None = None
    config: dict = field(default_factory=dict)
    timeout_secs: int = 300
    retry: dict | None = None


@dataclass
class Pipeline:
    uid: str
    steps: list[Step]
    name: str = ""
    tenant_id: str | None = None
    builtin: bool = False
    version: int = 1

    @classmethod
    def parse(cls, definition: dict) -> Pipeline:
        known = {k: v for k, v in definition.items() if k in cls.__dataclass_fields__ and k != "steps"}
        return cls(steps=[Step(**s) for s in definition.get("steps", [])], **known).normalize()

    def normalize(self) -> Pipeline:
        """Steps without dependencies follow the step before them; the first one has none."""
        for before, step in zip(self.steps, self.steps[1:], strict=False):
            step.depends_on = step.depends_on or [before.id]
        self.name = self.name or self.uid
        return self

    def order(self) -> list[str]:
        """Steps so that dependencies come first, by position among those that are ready; raises PipelineError."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", self.uid):
            raise PipelineError("InvalidUid", self.uid)
        if not self.steps:
            raise PipelineError("Empty")
        at = {s.id: n for n, s in enumerate(self.steps)}
        if len(at) < len(self.steps):
            raise PipelineError("DuplicateStep")
        for s in self.steps:
            if missing := [d for d in s.depends_on if d not in at]:
                raise PipelineError("UnknownDependency", f"{s.id}: {missing[0]}")
            if s.fan_out is not None:
                self._check_fan_out(s)
        graph, out = TopologicalSorter({s.id: s.depends_on for s in self.steps}), []
        try:
            graph.prepare()
        except CycleError as e:
            raise PipelineError("Cycle", str(e.args[1])) from None
        queue = sorted(graph.get_ready(), key=at.get)
        while queue:
            step = queue.pop(0)
            out.append(step)
            graph.done(step)
            queue += sorted(graph.get_ready(), key=at.get)
        return out

    def _check_fan_out(self, s: Step) -> None:
        if len(s.depends_on) != 1:
            raise PipelineError("FanOutArity", s.id)
        if s.fan_out not in FAN_OUT_PATHS:
            raise PipelineError("FanOutPath", f"{s.id}: {s.fan_out}")
        if s.plugin == SINK and s.fan_out != "$" and s.config.get("prune") is True:
            raise PipelineError("PruneWithFanOut", s.id)

    def ready(self, done: set[str]) -> list[str]:
        by_id = {s.id: s for s in self.steps}
        return [x for x in self.order() if x not in done and set(by_id[x].depends_on) <= done]

    def fixed_index(self) -> str | None:
        """The index that every sink step names; null unless all name one and the same."""
        named = {s.config.get("index") for s in self.steps if s.plugin == SINK}
        return named.pop() if len(named) == 1 else None


def builtin_pipelines() -> list[Pipeline]:
    return [Pipeline.parse({"uid": uid, "builtin": True, "steps": [dict(s) for s in steps]}) for uid, (_, steps) in BUILTIN.items()]


def inject(config: dict, context: dict, pinned: bool = False) -> dict:
    """A sink's config with the request's context: host and key are the request's unless pinned; the rest fills what is unset or blank."""
    blank = lambda v: v is None or (isinstance(v, str) and not v.strip())
    return config | {k: v for k, v in context.items() if (k in ("host", "api_key") and not pinned) or blank(config.get(k))}


def retry_params(policy: dict | None) -> dict:
    """attempts, first delay and factor of a step's retries."""
    policy = policy or {}
    factor = {"exponential": 2.0, "linear": 1.0, "none": 1.0}[policy.get("backoff", "exponential")]
    return {"attempts": policy.get("max_attempts", 3), "delay": 0.0 if policy.get("backoff") == "none" else policy.get("delay_secs", 1.0), "factor": factor}


def merge_total(pipeline: Pipeline, step: str) -> int | None:
    """How many outputs the widest step behind `step` takes together; null if none takes more than one."""
    return max((len(s.depends_on) for s in pipeline.steps if step in s.depends_on and len(s.depends_on) > 1), default=None)


@dataclass(frozen=True)
class Manifest:
    """What an operator takes (kinds of input: bytes, documents, many, empty; none for all) and gives."""

    name: str
    accepts: tuple[str, ...]
    produces: str

    def check(self, kind: str) -> None:
        """Many outputs together also count as documents."""
        if self.accepts and kind not in self.accepts and not (kind == "many" and "documents" in self.accepts):
            raise PipelineError("InvalidInput", f"plugin {self.name} accepts {', '.join(self.accepts)} but received {kind}")


#: name -> (rows in, config) -> rows out.
Operator = Callable[[DataFrame, dict], DataFrame]


def build(pipeline: Pipeline, source: DataFrame, operators: dict[str, Operator], manifests: dict[str, Manifest] | None = None) -> dict[str, DataFrame]:
    """The output of every step, as lazy DataFrames: one plan that Spark optimizes whole. Several inputs are a union in the
    order of the dependencies. Every step works on partitions anyway, so a fan-out adds no shuffle: what it makes of its
    input is checked. With manifests, so is what every step takes: a source is bytes if it has `data`, else documents.
    """
    done: dict[str, DataFrame] = {}
    gives: dict[str, str] = {}
    by_id = {s.id: s for s in pipeline.steps}
    for name in pipeline.order():
        step = by_id[name]
        if step.plugin not in operators:
            raise PipelineError("UnknownPlugin", f"unknown plugin {step.plugin}")
        inputs = [done[d] for d in step.depends_on]
        kinds = [gives[d] for d in step.depends_on] or ["bytes" if "data" in source.columns else "documents"]
        manifest = (manifests or {}).get(step.plugin)
        if step.fan_out == "$.documents" and kinds[0] == "bytes":
            raise PipelineError("InvalidInput", f"{name}: bytes have no documents to fan out")
        if manifest:
            manifest.check("documents" if step.fan_out == "$.documents" else "many" if len(kinds) > 1 else kinds[0])
        gives[name] = "many" if step.fan_out else manifest.produces if manifest else "documents"
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs) if inputs else source
        done[name] = operators[step.plugin](df, step.config)
    return done
