"""Configurations of the four pipelines, read from YAML and checked before anything runs."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from ..errors import ConfigError
from ..operators.models import MODELS
from ..operators.ols import ROBUST
from ..operators.validation import Design

KINDS = ("rook", "queen", "knn", "distance_band")
# Other names that configurations have for the same things.
ALIASES = {"type": "kind", "boundary_tolerance": "tolerance", "predictors": "regressors", "robust_covariance": "robust", "transformation": "transform"}
DISTANCE = ("distance", "distance_band")
TRANSFORMS = ("binary", "row_standardized")
SYMMETRIES = ("none", "union", "mutual")


def read(path: str) -> dict[str, Any]:
    file = Path(path)
    if not file.is_file():
        raise ConfigError(f"{path} does not exist")
    raw = yaml.safe_load(file.read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} holds no mapping")
    return raw


def need(raw: dict, key: str) -> Any:
    """``a.b`` of nested mappings; missing and empty values are errors."""
    at: Any = raw
    for part in key.split("."):
        if not isinstance(at, dict) or at.get(part) in (None, ""):
            raise ConfigError(f"the configuration lacks {key!r}")
        at = at[part]
    return at


def resolve(value: str, config_path: str) -> str:
    """Relative paths start at the configuration's folder."""
    return value if "://" in value or Path(value).is_absolute() else str(Path(config_path).parent / value)


def check(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigError(message)


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    check(value in allowed, f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def unique(names: list[str], what: str) -> None:
    check(bool(names), f"at least one of {what} is needed")
    check(len(set(names)) == len(names), f"names of {what} repeat")


def made(kind: type, values: Any, what: str) -> Any:
    """An object of a configuration class; unknown and missing keys are errors."""
    check(isinstance(values, dict), f"{what} must be a mapping")
    values = {ALIASES.get(k, k): v for k, v in values.items()}
    if values.get("kind") in DISTANCE and kind is WeightSpec:
        values["kind"] = "distance_band"
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(values) - set(known))
    check(not unknown, f"{what} has unknown keys: {', '.join(unknown)}")
    missing = [n for n, f in known.items() if n not in values and f.default is MISSING and f.default_factory is MISSING]
    check(not missing, f"{what} lacks {', '.join(missing)}")
    return kind(**values)


def known(kind: type, values: dict) -> dict:
    unknown = sorted(set(values) - {f.name for f in fields(kind)})
    check(not unknown, f"unknown keys: {', '.join(unknown)}")
    return values


def code(crs: Any) -> int:
    """An EPSG code, as a number or as ``EPSG:number``."""
    text = str(crs).upper().removeprefix("EPSG:")
    check(text.isdigit(), f"{crs!r} is no EPSG code")
    return int(text)


def several(raw: dict, key: str) -> list:
    values = need(raw, key)
    check(isinstance(values, list), f"{key} must be a list")
    return values


def folder(raw: dict, path: str) -> tuple[str, dict]:
    """The output folder, and what else the section ``output`` says."""
    value = need(raw, "output")
    section = dict(value) if isinstance(value, dict) else {"directory": value}
    named = section.pop("directory", None) or section.pop("dir", None)
    check(bool(named), "the configuration lacks an output folder")
    return resolve(str(named), path), section


@dataclass(frozen=True)
class WeightSpec:
    name: str
    kind: str = "rook"
    transform: str = "row_standardized"
    k: int | None = None
    threshold: float | None = None
    distance_power: float = 0.0
    symmetrization: str = "union"
    tolerance: float = 1e-9

    def __post_init__(self) -> None:
        one_of(self.kind, KINDS, "kind of weights")
        one_of(self.transform, TRANSFORMS, "transform")
        one_of(self.symmetrization, SYMMETRIES, "symmetrization")
        check(self.kind != "knn" or (self.k or 0) >= 1, "knn weights need k of at least 1")
        check(self.kind != "distance_band" or (self.threshold or 0) > 0, "distance bands need a positive threshold")
        check(self.distance_power >= 0 and self.tolerance >= 0, "powers and tolerances must not be negative")


@dataclass(frozen=True)
class Autocorrelation:
    input: str
    id_column: str
    value_column: str
    crs: int
    output: str
    weights: list[WeightSpec]
    primary: str
    layer: str | None = None
    permutations: int = 999
    seed: int = 42
    alpha: float = 0.05
    alternative: str = "two-sided"
    fdr: bool = True
    maps: bool = True

    def __post_init__(self) -> None:
        check(self.permutations >= 19, "at least 19 permutations are needed")
        check(0 < self.alpha < 1, "alpha must lie between 0 and 1")
        one_of(self.alternative, ("two-sided", "greater", "less"), "alternative")
        unique([w.name for w in self.weights], "weights")
        check(self.primary in {w.name for w in self.weights}, "the primary weights are not defined")


@dataclass(frozen=True)
class ModelSpec:
    name: str
    target: str
    regressors: list[str]
    robust: str = "HC3"

    def __post_init__(self) -> None:
        one_of(self.robust, ROBUST, "robust covariance")
        check(bool(self.regressors), f"model {self.name!r} has no regressors")


@dataclass(frozen=True)
class EdgeSpec:
    name: str
    path: str
    transform: str = "row_standardized"

    def __post_init__(self) -> None:
        one_of(self.transform, TRANSFORMS, "transform")


@dataclass(frozen=True)
class Regression:
    input: str
    id_column: str
    output: str
    models: list[ModelSpec]
    weights: list[EdgeSpec]
    layer: str | None = None
    permutations: int = 999
    seed: int = 42
    alpha: float = 0.05
    maps: bool = True

    def __post_init__(self) -> None:
        check(self.permutations >= 99, "at least 99 permutations are needed")
        check(0 < self.alpha < 1, "alpha must lie between 0 and 1")
        unique([m.name for m in self.models], "models")
        unique([w.name for w in self.weights], "weights")


@dataclass(frozen=True)
class Preparation:
    spatial: str
    table: str
    spatial_key: str
    table_key: str
    crs: int
    output: str
    numeric_columns: list[str] = field(default_factory=list)
    repair: bool = True
    allow_empty: bool = False
    minimum_match_rate: float = 1.0
    map_column: str | None = None
    map_method: str = "quantiles"
    map_classes: int = 5

    def __post_init__(self) -> None:
        check(0 <= self.minimum_match_rate <= 1, "minimum_match_rate must lie between 0 and 1")
        one_of(self.map_method, ("quantiles", "equal_interval"), "map method")


@dataclass(frozen=True)
class Experiment:
    dataset: dict
    output: str
    designs: list[Design]
    models: dict[str, dict[str, list]]
    seed: int = 42
    repetitions: int = 1
    inner_splits: int = 3
    coverage: float = 0.9
    permutations: int = 99
    k: int = 8
    alpha: float = 0.05
    features: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        unique([d.name for d in self.designs], "designs")
        check(all(m in MODELS for m in self.models) and bool(self.models), f"models must be among {', '.join(MODELS)}")
        check(0 < self.coverage < 1 and 0 < self.alpha < 1, "coverage and alpha must lie between 0 and 1")
        check(self.repetitions >= 1 and self.inner_splits >= 2, "repetitions and inner splits are too few")


def autocorrelation(path: str) -> Autocorrelation:
    """Sections data, analysis (weights, primary_weight and inference) and output; or weights,
    primary and inference at the top."""
    raw = read(path)
    data, analysis = dict(need(raw, "data")), dict(raw.get("analysis") or {})
    output, extra = folder(raw, path)
    weights = [made(WeightSpec, w, f"weights[{k}]") for k, w in enumerate(several(analysis if "weights" in analysis else raw, "weights"))]
    analysis.pop("weights", None)
    primary = analysis.pop("primary_weight", None) or raw.get("primary") or weights[0].name
    crs = data.get("analysis_crs") or need(raw, "data.crs")
    values = {
        "input": resolve(need(raw, "data.path"), path), "id_column": need(raw, "data.id_column"), "value_column": need(raw, "data.value_column"), "crs": code(crs), "output": output,
        "weights": weights, "primary": primary, "layer": data.get("layer"), "maps": extra.get("maps", raw.get("maps", True)),
    }
    return made(Autocorrelation, {**values, **raw.get("inference", {}), **analysis}, "the analysis")


def regression(path: str) -> Regression:
    """Sections data, models, weights and output; permutations, seed and alpha at the top or in
    inference."""
    raw = read(path)
    output, extra = folder(raw, path)
    models = []
    for k, m in enumerate(several(raw, "models")):
        check(isinstance(m, dict) and m.get("add_constant", True), f"models[{k}] must be a mapping and have a constant")
        models.append(made(ModelSpec, {n: v for n, v in m.items() if n != "add_constant"}, f"models[{k}]"))
    weights = []
    for k, w in enumerate(several(raw, "weights")):
        check(isinstance(w, dict) and bool(w.get("path")), f"weights[{k}] lacks a path")
        weights.append(made(EdgeSpec, {**w, "path": resolve(w["path"], path)}, f"weights[{k}]"))
    values = {
        "input": resolve(need(raw, "data.path"), path), "id_column": need(raw, "data.id_column"), "output": output, "models": models, "weights": weights,
        "layer": raw["data"].get("layer"), "maps": extra.get("maps", raw.get("maps", True)),
    }
    top = {k: raw[k] for k in ("permutations", "seed", "alpha") if k in raw}
    return made(Regression, {**values, **raw.get("inference", {}), **top}, "the regression")


def preparation(path: str) -> Preparation:
    raw = read(path)
    if "paths" in raw:
        raw = sections(raw)
    paths = {k: resolve(need(raw, k), path) for k in ("spatial", "table", "output")}
    return made(Preparation, {**raw, **paths, "crs": code(need(raw, "crs"))}, "the preparation")


def sections(raw: dict) -> dict:
    """The configuration in sections paths, keys, crs, geometry, join, table and map as a flat one."""
    part = lambda name: raw.get(name) or {}
    out = {
        "spatial": need(raw, "paths.spatial"), "table": need(raw, "paths.table"), "output": need(raw, "paths.output_dir"),
        "spatial_key": need(raw, "keys.spatial"), "table_key": need(raw, "keys.table"), "crs": need(raw, "crs.analysis"),
        "repair": part("geometry").get("repair_invalid"), "allow_empty": part("geometry").get("allow_empty"), "minimum_match_rate": part("join").get("minimum_match_rate"),
        "numeric_columns": part("table").get("numeric_columns"), "map_column": part("map").get("column"), "map_method": part("map").get("scheme"), "map_classes": part("map").get("k"),
    }
    return {k: v for k, v in out.items() if v is not None}


def experiment(path: str) -> Experiment:
    raw = read(path)
    dataset = dict(need(raw, "dataset"))
    if "path" in dataset:
        dataset["path"] = resolve(dataset["path"], path)
    values = {k: v for k, v in raw.items() if k not in ("dataset", "designs", "output", "models")}
    return Experiment(dataset=dataset, output=resolve(need(raw, "output"), path), designs=[made(Design, d, f"designs[{k}]") for k, d in enumerate(several(raw, "designs"))], models=need(raw, "models"), **known(Experiment, values))
