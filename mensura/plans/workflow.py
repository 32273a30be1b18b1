"""Research workflow on the driver: hypotheses, method selection, approved steps, gates, provenance, tools.

The control flow is plain Python; steps return lazy DataFrames, which are materialised when their
step ends so that a failure belongs to its step.  Rankings, traces and manifests become tables.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import importlib.util
import json
import os
import platform
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from enum import StrEnum
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import inference
from mensura.operators.validation import FAIL, WARNING
from mensura.sources.files import resolve_target

# ---- hypotheses --------------------------------------------------------------------------


class Domain(StrEnum):
    GENERAL_SCIENCE = "general_science"
    PHYSICS = "physics"
    BIOLOGY = "biology"
    CHEMISTRY = "chemistry"
    SOCIAL_SCIENCE = "social_science"
    COMPUTER_SCIENCE = "computer_science"


class HypothesisStatus(StrEnum):
    PROPOSED = "proposed"
    TESTING = "testing"
    SUPPORTED = "supported"
    REFUTED = "refuted"


@dataclass
class Hypothesis:
    statement: str
    domain: Domain = Domain.GENERAL_SCIENCE
    research_question: str = ""
    rationale: str | None = None
    assumptions: list[str] = field(default_factory=list)
    predictions: list[str] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    status: HypothesisStatus = HypothesisStatus.PROPOSED
    confidence: float = 0.5
    metadata: dict[str, str] = field(default_factory=dict)
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def __post_init__(self) -> None:
        if not self.statement.strip() or not 0 <= self.confidence <= 1:
            raise ValueError("a hypothesis has a statement and a confidence from 0 to 1")


def hypothesis_table(spark: SparkSession, rows: Sequence[Hypothesis]) -> DataFrame:
    schema = "statement string, domain string, research_question string, rationale string, assumptions array<string>, predictions array<string>, variables array<string>, references array<string>, status string, confidence double, metadata map<string,string>, id string, created string"
    return spark.createDataFrame([tuple(str(v) if isinstance(v, StrEnum) else v for v in vars(h).values()) for h in rows], schema)


class HypothesisGenerator(Protocol):
    def generate(self, question: str, domain: Domain, n: int) -> list[Hypothesis]: ...


@dataclass
class PromptTemplate:
    template: str

    def render(self, **values: str) -> str:
        return self.template.format(**values)


class SimpleOfflineGenerator:
    """Statements from templates, the same for the same question."""

    templates = ("{q}: the effect grows with its main cause.", "{q}: there is no effect beyond chance.", "{q}: the effect depends on a third factor.", "{q}: the relation is not linear.")

    def generate(self, question: str, domain: Domain = Domain.GENERAL_SCIENCE, n: int = 3) -> list[Hypothesis]:
        return [Hypothesis(PromptTemplate(self.templates[i % len(self.templates)]).render(q=question), domain, question, id=hashlib.sha256(f"{domain}|{question}|{i}".encode()).hexdigest()[:16]) for i in range(n)]


def generate_hypotheses(question: str, domain: Domain = Domain.GENERAL_SCIENCE, n: int = 3, generator: HypothesisGenerator | None = None) -> list[Hypothesis]:
    return (generator or SimpleOfflineGenerator()).generate(question, domain, n)


@dataclass
class HypothesisEvaluator:
    """Tests over long tables (group, value); significant means p < alpha."""

    alpha: float = 0.05

    def _judge(self, h: Hypothesis, name: str, test: DataFrame, alpha: float | None = None) -> DataFrame:
        sig = F.col("p_value") < (alpha or self.alpha)
        return test.select(F.lit(h.id).alias("hypothesis_id"), F.lit(name).alias("test_name"), F.col("statistic").cast("double").alias("statistic"), "p_value", sig.alias("is_significant"), F.when(sig, "supported").otherwise("not supported").alias("conclusion"))

    def compare_groups(self, h: Hypothesis, df: DataFrame, value: str, group: str) -> DataFrame:
        """Two groups: pooled t test; more: analysis of variance."""
        labels = [r[0] for r in df.select(group).distinct().orderBy(group).limit(3).collect()]
        if len(labels) < 2:
            raise ValueError("needs two groups")
        if len(labels) == 2:
            return self._judge(h, "two-sample-t", inference.two_sample_ttest(df, value, group, *labels))
        return self._judge(h, "anova", inference.one_way_anova(df, value, group))

    def compare_to_reference(self, h: Hypothesis, df: DataFrame, value: str, popmean: float) -> DataFrame:
        return self._judge(h, "one-sample-t", inference.one_sample_ttest(df, value, popmean))

    def compare_paired(self, h: Hypothesis, df: DataFrame, first: str, second: str) -> DataFrame:
        return self._judge(h, "paired-t", inference.paired_ttest(df, first, second))

    def goodness_of_fit(self, h: Hypothesis, df: DataFrame, observed: str, expected: str | None = None) -> DataFrame:
        if expected is None:
            df, expected = df.crossJoin(F.broadcast(df.agg(F.avg(observed).alias("_e")))), "_e"
        return self._judge(h, "chi-square-gof", inference.chi_square_gof(df, observed, expected))

    def test_independence(self, h: Hypothesis, df: DataFrame, a: str, b: str) -> DataFrame:
        return self._judge(h, "chi-square-independence", inference.chi_square_independence(df, a, b))

    def evaluate(self, h: Hypothesis, data: dict[str, dict]) -> DataFrame:
        """data: exactly one of groups, one_sample, paired, chi_square_gof, chi_square_independence, with the method's arguments."""
        run = {"groups": self.compare_groups, "one_sample": self.compare_to_reference, "paired": self.compare_paired, "chi_square_gof": self.goodness_of_fit, "chi_square_independence": self.test_independence}
        if len(data) != 1 or next(iter(data)) not in run:
            raise ValueError("give exactly one kind of data")
        kind, args = next(iter(data.items()))
        return run[kind](h, **args)

    def evaluate_batch(self, hypotheses: Sequence[Hypothesis], items: Sequence[dict]) -> DataFrame:
        """All results, judged at alpha over their number."""
        strict = HypothesisEvaluator(inference.bonferroni_corrected_alpha(self.alpha, len(hypotheses)))
        out = None
        for h, d in zip(hypotheses, items, strict=True):
            r = strict.evaluate(h, d)
            out = r if out is None else out.unionByName(r)
        return out


# ---- selection of methods ----------------------------------------------------------------


class ConditionStatus(StrEnum):
    PASS = "pass"
    FAIL = "fail"
    UNKNOWN = "unknown"


_OPS: dict[str, Callable[[Any, Any], bool]] = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "in": lambda a, b: a in b, "not_in": lambda a, b: a not in b}


@dataclass(frozen=True)
class SelectionCondition:
    key: str
    operator: str
    expected: Any
    description: str = ""

    def check(self, facts: dict[str, Any]) -> ConditionStatus:
        """Unknown for a missing fact or one that can't be compared."""
        if self.operator not in _OPS:
            raise ValueError(f"unknown operator: {self.operator}")
        if facts.get(self.key) is None:
            return ConditionStatus.UNKNOWN
        try:
            return ConditionStatus.PASS if _OPS[self.operator](facts[self.key], self.expected) else ConditionStatus.FAIL
        except TypeError:
            return ConditionStatus.UNKNOWN


@dataclass(frozen=True)
class MethodSelectionContext:
    facts: dict[str, Any] = field(default_factory=dict)
    required_capabilities: tuple[str, ...] = ()
    preferred_capabilities: tuple[str, ...] = ()
    preferred_traits: tuple[str, ...] = ()
    available_tools: tuple[str, ...] = ()


@dataclass(frozen=True)
class MethodPreference:
    condition: SelectionCondition
    weight: float = 1.0


@dataclass(frozen=True)
class MethodCandidate:
    name: str
    rationale: str = ""
    capabilities: tuple[str, ...] = ()
    traits: tuple[str, ...] = ()
    required_tools: tuple[str, ...] = ()
    requirements: tuple[SelectionCondition, ...] = ()
    preferences: tuple[MethodPreference, ...] = ()


@dataclass(frozen=True)
class SelectionPolicy:
    preferred_capability_weight: float = 1.0
    preferred_trait_weight: float = 0.5
    unknown_requirements_block: bool = False


@dataclass(frozen=True)
class RankedMethod:
    candidate: MethodCandidate
    status: str
    score: float
    reasons: tuple[str, ...]


def rank_methods(candidates: Sequence[MethodCandidate], context: MethodSelectionContext, policy: SelectionPolicy = SelectionPolicy()) -> list[RankedMethod]:
    """Blocked for a missing capability or tool or a failed requirement, up for review with unknown ones; best first, ties by name."""
    out = []
    for c in candidates:
        reasons = [f"lacks {x}" for x in context.required_capabilities if x not in c.capabilities] + [f"needs {x}" for x in c.required_tools if x not in context.available_tools]
        unknown = []
        for r in c.requirements:
            s = r.check(context.facts)
            if s == ConditionStatus.FAIL:
                reasons.append(f"fails {r.key}")
            elif s == ConditionStatus.UNKNOWN:
                unknown.append(f"unknown {r.key}")
        blocked = bool(reasons) or bool(unknown) and policy.unknown_requirements_block
        score = policy.preferred_capability_weight * sum(x in c.capabilities for x in context.preferred_capabilities) + policy.preferred_trait_weight * sum(x in c.traits for x in context.preferred_traits)
        score += sum(p.weight for p in c.preferences if p.condition.check(context.facts) == ConditionStatus.PASS)
        out.append(RankedMethod(c, "blocked" if blocked else "review" if unknown else "eligible", score, tuple(reasons + unknown)))
    rank = {"eligible": 0, "review": 1, "blocked": 2}
    return sorted(out, key=lambda r: (rank[r.status], -r.score, r.candidate.name))


def recommended(ranked: Sequence[RankedMethod]) -> RankedMethod | None:
    return next((r for r in ranked if r.status != "blocked"), None)


# ---- tools -------------------------------------------------------------------------------


@dataclass(frozen=True)
class ToolSpec:
    name: str
    module: str
    capabilities: tuple[str, ...]
    purpose: str = ""
    locality: str = "local"
    data_egress: bool = False

    @property
    def available(self) -> bool:
        return importlib.util.find_spec(self.module) is not None

    @property
    def version(self) -> str | None:
        try:
            return importlib.metadata.version(self.module)
        except importlib.metadata.PackageNotFoundError:
            return None


@dataclass
class ToolRegistry:
    tools: dict[str, ToolSpec] = field(default_factory=dict)

    def register(self, spec: ToolSpec) -> None:
        if spec.name in self.tools:
            raise ValueError(f"{spec.name} is registered already")
        self.tools[spec.name] = spec

    def status(self) -> list[tuple[ToolSpec, bool, str | None]]:
        return [(t, t.available, t.version) for t in self.tools.values()]

    def with_capability(self, capability: str) -> list[ToolSpec]:
        return [t for t in self.tools.values() if capability in t.capabilities]


def default_registry() -> ToolRegistry:
    r = ToolRegistry()
    for name, caps in (("numpy", ("linear-algebra",)), ("pandas", ("tables",)), ("scipy", ("optimization", "statistics")), ("sympy", ("symbolic",)), ("z3", ("satisfiability",)), ("sklearn", ("machine-learning",)), ("matplotlib", ("plotting",)), ("pyspark", ("tables", "distributed"))):
        r.register(ToolSpec(name, name, caps))
    return r


def select_tool(capability: str, registry: ToolRegistry | None = None, preferred: Sequence[str] = (), prefer_local: bool = True, sensitive_data: bool = False, allow_remote_fallback: bool = False) -> ToolSpec:
    """An available tool: no egress of sensitive data, remote only where allowed, preferred names first."""
    found = [t for t in (registry or default_registry()).with_capability(capability) if t.available and not (sensitive_data and t.data_egress) and (t.locality == "local" or allow_remote_fallback)]
    if not found:
        raise LookupError(f"no tool for {capability}")
    return min(found, key=lambda t: (preferred.index(t.name) if t.name in preferred else len(preferred), prefer_local and t.locality != "local", t.name))


def _module(name: str):
    if importlib.util.find_spec(name) is None:
        raise ModuleNotFoundError(f"{name} is needed here and is not installed")
    return importlib.import_module(name)


def scipy_minimize(objective: Callable, initial: Sequence[float], method: str | None = None, options: dict | None = None) -> dict:
    r = _module("scipy.optimize" if importlib.util.find_spec("scipy") else "scipy").minimize(objective, initial, method=method, options=options)
    return {"parameters": tuple(map(float, r.x)), "objective": float(r.fun), "success": bool(r.success), "message": str(r.message), "iterations": getattr(r, "nit", None)}


def sympy_verify_identity(left: str, right: str) -> bool:
    s = _module("sympy")
    return s.simplify(s.sympify(left) - s.sympify(right)) == 0


def z3_satisfiability(build_constraints: Callable) -> str:
    z = _module("z3")
    solver = z.Solver()
    solver.add(*build_constraints(z))
    return str(solver.check())


# ---- provenance --------------------------------------------------------------------------


def canonical_sha256(value: object) -> str:
    """Of compact JSON with sorted keys; NaN is refused."""
    return sha256_text(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def sha256_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sha256_text(text: str, encoding: str = "utf-8") -> str:
    return sha256_bytes(text.encode(encoding))


def sha256_file(path: str | os.PathLike[str]) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def table_hash(df: DataFrame) -> DataFrame:
    """One row (hash, rows) that does not depend on the order of rows."""
    h = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.sum(h).cast("string").alias("hash"), F.count(F.lit(1)).alias("rows"))


def detect_git_sha() -> str | None:
    for name in ("GIT_SHA", "GITHUB_SHA"):
        if os.environ.get(name):
            return os.environ[name]
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


@dataclass
class DecisionRecord:
    action: str
    rationale: str
    approved_by_user: bool


@dataclass
class RunManifest:
    question: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_utc: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    seed: int | None = None
    data_hashes: dict[str, str] = field(default_factory=dict)
    tool_versions: dict[str, str] = field(default_factory=dict)
    environment: dict[str, str] = field(default_factory=lambda: {"python": platform.python_version(), "platform": platform.platform()})
    decisions: list[DecisionRecord] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> RunManifest:
        return cls(**{**d, "decisions": [DecisionRecord(**x) for x in d["decisions"]]})


def save_checkpoint(path: str | os.PathLike[str], manifest: RunManifest, state: dict, root: str | os.PathLike[str] | None = None) -> None:
    """Written beside and renamed, so a reader sees the old file or the new one."""
    target = resolve_target(path, root)
    body = json.dumps({"manifest": manifest.to_dict(), "state": state, "sha256": canonical_sha256(state)}, allow_nan=False)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as f:
        f.write(body)
    Path(f.name).replace(target)


def load_checkpoint(path: str | os.PathLike[str], root: str | os.PathLike[str] | None = None) -> tuple[RunManifest, dict]:
    d = json.loads(resolve_target(path, root).read_text(encoding="utf-8"))
    if canonical_sha256(d["state"]) != d["sha256"]:
        raise ValueError("the checkpoint is damaged")
    return RunManifest.from_dict(d["manifest"]), d["state"]


# ---- workflow ----------------------------------------------------------------------------


@dataclass(frozen=True)
class PlanStep:
    id: str
    description: str
    method: str = ""
    rationale: str = ""
    requires_approval: bool = True


@dataclass(frozen=True)
class Recommendation:
    recommended: str
    rationale: str = ""
    alternatives: tuple[str, ...] = ()


@dataclass(frozen=True)
class AnalysisRequest:
    question: str
    require_plan_approval: bool = True
    prefer_local: bool = True
    sensitive_data: bool = False
    allow_remote_fallback: bool = False


@dataclass(frozen=True)
class AnalysisPlan:
    request: AnalysisRequest
    steps: tuple[PlanStep, ...]
    recommendation: Recommendation | None = None

    def __post_init__(self) -> None:
        if len({s.id for s in self.steps}) != len(self.steps):
            raise ValueError("step ids repeat")

    def digest(self) -> str:
        return canonical_sha256(asdict(self))


@dataclass(frozen=True)
class ExecutionEvent:
    step_id: str
    status: str
    message: str = ""


@dataclass
class ResearchWorkflow:
    """Steps in their order, each after its approval; the first denial or failure ends the run."""

    plan: AnalysisPlan
    actions: dict[str, Callable[[dict[str, Any]], Any]] = field(default_factory=dict)

    def register(self, step_id: str, action: Callable[[dict[str, Any]], Any]) -> None:
        if step_id not in {s.id for s in self.plan.steps} or step_id in self.actions:
            raise ValueError(f"unknown or repeated step: {step_id}")
        self.actions[step_id] = action

    def execute(self, approve: Callable[[PlanStep], bool] | None = None, approve_plan: Callable[[AnalysisPlan], bool] | None = None) -> tuple[dict[str, Any], list[ExecutionEvent]]:
        """Values and events.  What needs approval is denied where nobody is asked: the whole plan if its request says so, and each step."""
        if missing := [s.id for s in self.plan.steps if s.id not in self.actions]:
            raise ValueError(f"steps without actions: {missing}")
        if self.plan.request.require_plan_approval and not (approve_plan and approve_plan(self.plan)):
            return {}, [ExecutionEvent("plan", "denied")]
        values, events, cached = {}, [], []
        for s in self.plan.steps:
            if s.requires_approval and not (approve and approve(s)):
                events.append(ExecutionEvent(s.id, "denied"))
                break
            try:
                out = self.actions[s.id](values)
                if isinstance(out, DataFrame):
                    cached.append(out.persist())
                    out.count()
                values[s.id] = out
                events.append(ExecutionEvent(s.id, "completed"))
            except Exception as e:  # a step's failure is a result of the run
                events.append(ExecutionEvent(s.id, "failed", f"{type(e).__name__}: {e}"))
                break
        for out in cached:  # computed again where it is read later
            out.unpersist()
        return values, events


def register_tool_step(workflow: ResearchWorkflow, step_id: str, capability: str, action: Callable[[ToolSpec, dict], Any], manifest: RunManifest | None = None, **policy: Any) -> ToolSpec:
    tool = select_tool(capability, **policy)
    workflow.register(step_id, lambda values: action(tool, values))
    if manifest is not None:
        manifest.tool_versions[tool.name] = tool.version or "unknown"
    return tool


@dataclass(frozen=True)
class GatePolicy:
    require_recommendation: bool = True
    require_alternatives: bool = True
    require_validation: bool = True
    required_checks: tuple[str, ...] = ()
    warnings_require_review: bool = True


@dataclass(frozen=True)
class GateDecision:
    status: str
    reasons: tuple[str, ...] = ()
    missing_checks: tuple[str, ...] = ()


def evaluate_research_gate(plan: AnalysisPlan, checks: DataFrame | None, policy: GatePolicy = GatePolicy()) -> GateDecision:
    """blocked for failures, missing checks or a missing recommendation; review for warnings or missing alternatives; else ready."""
    rows = [] if checks is None else checks.select("name", "status").distinct().collect()
    missing = tuple(c for c in policy.required_checks if c not in {r["name"] for r in rows})
    reasons = [f"failed: {r['name']}" for r in rows if r["status"] == FAIL] + [f"missing: {c}" for c in missing]
    if policy.require_recommendation and plan.recommendation is None:
        reasons.append("no recommendation")
    if policy.require_validation and not rows:
        reasons.append("no validation")
    if reasons:
        return GateDecision("blocked", tuple(reasons), missing)
    warned = tuple(f"warning: {r['name']}" for r in rows if r["status"] == WARNING)
    lone = ("no alternatives",) * (policy.require_alternatives and not (plan.recommendation and plan.recommendation.alternatives))
    return GateDecision("review" if lone or warned and policy.warnings_require_review else "ready", (*warned, *lone))


@dataclass
class ResearchOrchestrator:
    """Classify, rank methods, plan, run after approval, validate, pass the gate."""

    classify: Callable[[AnalysisRequest], MethodSelectionContext]
    candidates: Sequence[MethodCandidate]
    planner: Callable[[AnalysisRequest, RankedMethod], tuple[AnalysisPlan, dict[str, Callable]]]
    validators: dict[str, Callable[[dict[str, Any]], DataFrame]] = field(default_factory=dict)
    policy: GatePolicy = GatePolicy()

    def run(self, spark: SparkSession, request: AnalysisRequest, approve: Callable[[PlanStep], bool] | None = None, approve_plan: Callable[[AnalysisPlan], bool] | None = None) -> dict[str, Any]:
        manifest = RunManifest(request.question)
        ranked = rank_methods(self.candidates, self.classify(request))
        best = recommended(ranked)
        if best is None:
            return {"gate": GateDecision("blocked", ("no method fits",)), "ranked": ranked, "manifest": manifest}
        plan, actions = self.planner(request, best)
        if plan.recommendation is None:
            plan = replace(plan, recommendation=Recommendation(best.candidate.name, best.candidate.rationale, tuple(r.candidate.name for r in ranked[1:] if r.status != "blocked")))
        flow = ResearchWorkflow(plan)
        for k, a in actions.items():
            flow.register(k, a)
        values, events = flow.execute(approve, approve_plan)
        checks = None
        for name, v in self.validators.items():
            try:
                c = v(values)
            except Exception as e:  # a validator's failure is a failed check
                c = spark.createDataFrame([(name, FAIL, f"{type(e).__name__}: {e}", {})], "name string, status string, message string, details map<string,string>")
            checks = c if checks is None else checks.unionByName(c)
        gate = evaluate_research_gate(plan, checks, self.policy)
        if any(e.status != "completed" for e in events):
            gate = GateDecision("blocked", (*gate.reasons, "a step did not complete"), gate.missing_checks)
        manifest.decisions.append(DecisionRecord("run", best.candidate.name, all(e.status != "denied" for e in events)))
        return {"gate": gate, "ranked": ranked, "plan": plan, "values": values, "trace": events, "checks": checks, "manifest": manifest}


def trace_table(spark: SparkSession, events: Sequence[ExecutionEvent]) -> DataFrame:
    return spark.createDataFrame([(i, e.step_id, e.status, e.message) for i, e in enumerate(events)], "seq int, step_id string, status string, message string")
