"""Playbooks and layered settings with a trace."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.classify import SETUPS


@dataclass(frozen=True)
class Playbook:
    """A kind of corpus: how it is chunked, what its gates are, and its own steps and rules."""

    name: str
    strategy: str
    max_tokens: int
    overlap_sentences: int
    overlap_chars: int
    min_sections: int
    max_mid_sentence: float
    steps: tuple[dict, ...] = ()
    headers: tuple[str, ...] = ()
    aliases: dict = field(default_factory=dict)
    rules: tuple[dict, ...] = ()


#: Fixed parameters: strategy, tokens, overlapping sentences and characters, least sections, greatest rate of cut sentences.
PLAYBOOKS = {
    p.name: p
    for p in (
        Playbook("ACADEMIC", "sentence", 1000, 2, 250, 7, 0.2), Playbook("ECOMMERCE", "fixed_size", 800, 1, 150, 3, 0.3), Playbook("FINANCIAL", "sentence", 1500, 2, 350, 6, 0.25),
        Playbook("HEALTHCARE", "sentence", 1200, 2, 300, 5, 0.2), Playbook("LEGAL", "sentence", 1800, 2, 400, 8, 0.15), Playbook("MEDICAL", "sentence", 800, 2, 640, 3, 0.25),
        Playbook("REGULATORY", "sentence", 900, 2, 300, 8, 0.4), Playbook("RETAIL", "fixed_size", 900, 1, 200, 4, 0.3), Playbook("SCANNED", "sentence", 900, 2, 300, 1, 0.6),
        Playbook("TECH", "sentence", 800, 1, 240, 3, 0.15),
    )
}


def playbook(name: str | None) -> Playbook:
    """By name in any case, with or without separators; TECH if there is none."""
    key = "".join(c for c in (name or "").upper() if c.isalnum())
    return PLAYBOOKS.get(key, PLAYBOOKS["TECH"])


def hint(playbook_name: str | None, use_case: str | None = None) -> str | None:
    """The kind of content that a playbook or a use suggests."""
    for text in (playbook_name, use_case):
        low = (text or "").lower()
        for part, kind in (("regul", "regulatory"), ("financ", "finance_banking"), ("bank", "finance_banking"), ("legal", "legal"), ("medic", "medical"), ("health", "medical"), ("academ", "academic"), ("tech", "technical")):
            if part in low:
                return kind
    return None


GLOBAL = {"chunk_size": 1000, "chunk_overlap": 200, "min_chunk_size": 100, "max_chunk_size": 2000, "strategy": "fixed_size"}
FIELDS = tuple(GLOBAL)


def resolve(run: dict | None = None, resolved: dict | None = None, manual: dict | None = None, kind: str | None = None, playbook_name: str | None = None, confidence: float = 1.0, least: float = 0.55) -> tuple[dict, dict]:
    """Settings and, for each, the layer it came from: run over resolved over manual over the content kind's over the playbook's over the global ones.

    A low confidence keeps the kind's sizes but cuts fixed windows; the overlap stays under the size.
    """
    layers: list[tuple[str, dict]] = [("global", GLOBAL)]
    if playbook_name:
        p = playbook(playbook_name)
        layers.append(("playbook", {"chunk_size": p.max_tokens, "chunk_overlap": p.overlap_chars // 4, "strategy": p.strategy}))
    if kind in SETUPS:
        s = dict(zip(("chunk_size", "chunk_overlap", "min_chunk_size", "max_chunk_size", "strategy"), SETUPS[kind], strict=True))
        layers.append(("content_type", s if confidence >= least else s | {"strategy": "fixed_size"}))
    layers += [(n, v) for n, v in (("manual", manual), ("resolved", resolved), ("run", run)) if v]
    out, trace = {}, {}
    for name, values in layers:
        for f in FIELDS:
            if values.get(f) is not None:
                out[f], trace[f] = values[f], name
    if out["chunk_overlap"] >= out["chunk_size"]:
        out["chunk_overlap"], trace["chunk_overlap"] = max(0, out["chunk_size"] - 1), "guard"
    return out, trace


def confident(confidence: Column, gap: Column, least: float = 0.7) -> Column:
    """A detection counts from `least`, or from 0.55 with a gap of 0.10 to the next."""
    return (confidence >= least) | ((confidence >= 0.55) & (gap >= 0.10))
