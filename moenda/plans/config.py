"""Configurations of preparations: read, checked, resolved and hashed.

A folder holds ``preparation.json`` and ``datasets/<data set>.json``.  What a key must hold is
stated in tables; values are compared with their type, so that true is not 1.
"""

from __future__ import annotations

import json
import os
import re
from copy import deepcopy
from typing import Any

from ..operators.boilerplate import Rules
from . import pipeline
from .manifest import digest

# What a preparation must hold, the budgets of profiles, and the ways to select.
PREPARATION = {
    "sequence_length": 1024, "seed": 42, "output_root": "derived", "storage.format": "parquet", "storage.compression": "zstd", "storage.sequences_per_shard": 1024,
    "tokenizer.trust_remote_code": False, "cleaning": {"unicode_normalization": "NFC", "strip_html": True, "strip_control_characters": True},
}
BUDGETS = {
    "smoke": {"train_sequences": 8, "eval_sequences": 2},
    "mvp": {"train_sequences": 256, "eval_sequences": 32},
    "real": {"eval_sequences": 256, "selection": "representative", "allocation_policy": "equal_share_without_replacement", "without_replacement": True},
}
SELECTIONS = ("engineering_prefix", "representative")
POSITIVE = ("train_sequences", "eval_sequences", "candidate_documents")
REVIEWED = "post_scan_review"


class ConfigError(ValueError):
    """A configuration is incomplete or unsafe."""


def same(a: Any, b: Any) -> bool:
    """Equal in value and type, all the way down."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def at(config: dict, path: str) -> Any:
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            raise ConfigError(f"{path} is missing")
        config = config[key]
    return config


def _require(config: dict, wanted: dict[str, Any], where: str) -> None:
    for path, value in wanted.items():
        if not same(at(config, path), value):
            raise ConfigError(f"{where}: {path} must be {value!r}")


def read(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
    except OSError:
        raise ConfigError(f"{os.path.basename(path)} can't be read") from None
    except ValueError as e:
        raise ConfigError(f"{os.path.basename(path)} is no JSON: {e}") from None
    if not isinstance(value, dict):
        raise ConfigError(f"{os.path.basename(path)} must hold an object")
    return value


def check_profile(profile: Any, name: str) -> None:
    if not isinstance(profile, dict):
        raise ConfigError(f"profile {name} must be an object")
    for key in POSITIVE:
        if type(profile.get(key)) is not int or profile[key] < 1:
            raise ConfigError(f"profile {name}: {key} must be a positive integer")
    if profile.get("selection") not in SELECTIONS:
        raise ConfigError(f"profile {name}: selection must be one of {', '.join(SELECTIONS)}")
    _require(profile, BUDGETS.get(name, {}), f"profile {name}")
    if name == "real" and not re.fullmatch("[0-9a-f]{64}", str(profile.get("allocation_sha256"))):
        raise ConfigError("profile real: allocation_sha256 must be a SHA-256")


def check_dataset(config: dict, dataset_id: str) -> None:
    if not re.fullmatch("[a-z][a-z0-9_]*", dataset_id):
        raise ConfigError("a data set's id has lower-case letters, digits and underscores")
    _require(config, {"dataset_id": dataset_id, "adapter": dataset_id}, dataset_id)
    for key in ("source", "filters", "profiles"):
        if not isinstance(at(config, key), dict):
            raise ConfigError(f"{key} must be an object")
    names = set(config["profiles"])
    if not {"smoke", "mvp"} <= names or names - set(BUDGETS):
        raise ConfigError("profiles are smoke, mvp and at most real")
    for name, profile in config["profiles"].items():
        check_profile(profile, name)


def check_preparation(config: dict) -> None:
    _require(config, PREPARATION, "preparation")
    for key in ("model_id", "revision"):
        if not isinstance(at(config, f"tokenizer.{key}"), str) or not config["tokenizer"][key]:
            raise ConfigError(f"tokenizer.{key} must be a name")


def load(folder: str, dataset_id: str, profile: str) -> tuple[dict, str]:
    """The resolved configuration and its digest."""
    preparation, dataset = read(os.path.join(folder, "preparation.json")), read(os.path.join(folder, "datasets", f"{dataset_id}.json"))
    check_preparation(preparation)
    check_dataset(dataset, dataset_id)
    if profile not in dataset["profiles"]:
        raise ConfigError(f"{dataset_id} has no profile {profile}; it has {', '.join(sorted(dataset['profiles']))}")
    resolved = {"dataset_id": dataset_id, "profile_name": profile, "preparation": preparation, "dataset": {k: v for k, v in dataset.items() if k != "profiles"}, "profile": dataset["profiles"][profile]}
    return resolved, digest(resolved)


def scan_digest(resolved: dict) -> str:
    """Digest of what scan and selection depend on: not of decisions taken after the report on boilerplate."""
    config = deepcopy(resolved)
    decisions = config["dataset"].get("filters", {}).get("boilerplate", {}).get("decision_by_profile", {})
    decisions.update(dict.fromkeys(decisions, REVIEWED))
    return digest(config)


def _below(path: str, root: str) -> bool:
    return os.path.commonpath([path, root]) == root


def output_root(wanted: str, data_root: str | None = None) -> str:
    """Where output goes: a folder that is no link, not too broad, and apart from the data."""
    if not wanted.strip():
        raise ConfigError("the output folder can't be empty")
    path = os.path.abspath(os.path.expanduser(wanted.strip()))
    if os.path.islink(path):
        raise ConfigError("the output folder must be no link")
    path = os.path.realpath(path)
    if path in (os.path.abspath(os.sep), os.path.realpath(os.path.expanduser("~"))) or (os.path.exists(path) and not os.path.isdir(path)):
        raise ConfigError("the output needs a folder of its own")
    if data_root and (_below(path, os.path.realpath(data_root)) or _below(os.path.realpath(data_root), path)):
        raise ConfigError("output and data must not overlap")
    return path


def dataset_root(resolved: dict, environment: dict[str, str]) -> str:
    name = resolved["dataset"]["source"].get("root_env", "")
    path = environment.get(name, "")
    if not os.path.isabs(path) or not os.path.isdir(path):
        raise ConfigError(f"{name or 'source.root_env'} must name the folder of the data, in full")
    return os.path.realpath(path)


def spec_of(resolved: dict) -> pipeline.Spec:
    """The preparation that a configuration asks for."""
    filters, profile = resolved["dataset"]["filters"], resolved["profile"]
    parts: dict[str, Any] = {}
    if kept := filters.get("boilerplate"):
        paragraphs, blocks, left = kept["cross_domain_paragraphs"], kept["within_domain_blocks"], kept["document_filter"]
        parts["decision"] = kept["decision_by_profile"].get(resolved["profile_name"], "pending")
        parts["rules"] = Rules(paragraphs["minimum_characters"], paragraphs["minimum_documents"], paragraphs["minimum_domains"], blocks["lines_per_block"], blocks["minimum_characters"], blocks["minimum_documents"], left["minimum_remaining_characters"], left["maximum_removed_fraction"])
        parts["line_characters"] = filters["line_filter"]["minimum_characters"]
    budget = pipeline.Profile(*(profile[k] for k in POSITIVE))
    return pipeline.Spec(resolved["dataset_id"], resolved["profile_name"], resolved["preparation"]["seed"], filters.get("min_characters", 1), filters.get("punctuation_spacing", "preserve"), profiles={resolved["profile_name"]: budget}, **parts)
