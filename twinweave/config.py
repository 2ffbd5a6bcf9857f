"""Settings of a run: thresholds, weights, caps and names."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# Namespaces, caps and hyper-parameters that results depend on.
RAW_NAMESPACE = "http://unpruned.local/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
DEFAULT_RELATION = "related_to"
ENTITY_TYPES = ("Algorithm", "Concept", "Hardware", "Institution", "Metric", "Other", "Person")


@dataclass(frozen=True)
class Settings:
    """One alignment run."""

    similarity_threshold: float | None = 0.75
    node_weight: float = 1.0
    structure_weight: float = 1.0
    left_penalty: float = 2.0
    right_penalty: float = 2.0
    max_structural_pairs: int | None = 2000
    annealer_reads: int = 100
    chunk_chars: int = 3500
    entities_per_chunk: int = 25
    triples_per_chunk: int = 20
    names_per_batch: int = 200
    embedding_dim: int = 64
    hidden_dim: int = 128
    epochs: int = 500
    learning_rate: float = 0.001
    weight_decay: float = 0.0001
    dropout: float = 0.2
    mmd_weight: float = 0.5
    moment_weight: float = 0.1
    anchor_weight: float = 1.0
    mmd_sample: int = 2048


def required(name: str, env: Mapping[str, str] | None = None) -> str:
    """A setting from the environment; one that is missing or blank is an error."""
    value = (os.environ if env is None else env).get(name, "").strip()
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value


EMBEDDING_MODES = {"text": (True, False), "graph": (False, True), "text_and_graph": (True, True)}


def parse_threshold(text: str) -> float | None:
    """A threshold from text: blank is none, anything outside [0, 1] an error."""
    text = text.strip()
    if not text:
        return None
    value = float(text)
    if not 0 <= value <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    return value


def parse_weight(text: str, name: str = "weight") -> float:
    """A non-negative weight from text; blank and negative values are errors."""
    if not text.strip():
        raise ValueError(f"{name} is missing")
    value = float(text)
    if value < 0 or value != value:
        raise ValueError(f"{name} must not be negative")
    return value
