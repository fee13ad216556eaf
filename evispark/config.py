"""The configuration of a run: five blocks of bounded values, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass, field, make_dataclass
from datetime import date
from typing import Any

from evispark.sources.files import read_config


@dataclass(frozen=True)
class Rule:
    """What a value may be: its kinds, its default (``...`` where it must be given) and its bounds."""

    kinds: tuple[type, ...]
    default: Any = ...
    least: float | None = None
    above: float | None = None
    most: float | None = None
    one_of: tuple[str, ...] = ()


_NUMBER, _TEXT, _COUNT, _LIST, _MAP, _FLAG = (int, float), (str,), (int,), (list,), (dict,), (bool,)
#: Blocks, their keys, defaults and bounds.
BLOCKS: dict[str, dict[str, Rule]] = {
    "research": {
        "question": Rule(_TEXT), "cutoff": Rule((date, str, type(None)), None), "instructions": Rule(_TEXT, ""), "labels": Rule(_MAP), "unknown_label": Rule(_TEXT), "fields": Rule(_MAP, {}),
    },
    "discovery": {
        "provider": Rule(_TEXT, "hybrid", one_of=("crawl", "openai", "hybrid")), "queries": Rule(_LIST, []), "keywords": Rule(_LIST, []), "max_searches_per_municipality": Rule(_COUNT, 3, 0, most=50),
        "max_documents": Rule(_COUNT, 20, 1, most=10_000), "max_depth": Rule(_COUNT, 2, 0, most=10), "max_sitemaps": Rule(_COUNT, 8, 0, most=100), "max_sitemap_urls": Rule(_COUNT, 10_000, 1),
    },
    "network": {
        "user_agent": Rule(_TEXT, "evispark (public research; name a contact)"), "timeout_seconds": Rule(_NUMBER, 30, above=0), "interval_seconds": Rule(_NUMBER, 1.0, 0), "retries": Rule(_COUNT, 3, 0, most=10),
        "max_bytes": Rule(_COUNT, 25_000_000, above=0), "max_redirects": Rule(_COUNT, 5, 0, most=10), "respect_robots": Rule(_FLAG, True),
    },
    "extraction": {"chunk_chars": Rule(_COUNT, 14_000, 100), "overlap_chars": Rule(_COUNT, 1_500, 0), "max_chunks_per_document": Rule(_COUNT, 100, 1), "min_page_chars": Rule(_COUNT, 30, 0)},
    "llm": {
        "models": Rule(_LIST, ["gpt-5-mini"], 1), "search_model": Rule(_TEXT, "gpt-5-mini"), "verifier_model": Rule(_TEXT, "gpt-5-mini"), "adjudicator_model": Rule(_TEXT, "gpt-5-mini"), "passes": Rule(_COUNT, 3, 1, most=10),
        "max_output_tokens": Rule(_COUNT, 6_000, 100), "timeout_seconds": Rule(_NUMBER, 120, above=0), "max_retries": Rule(_COUNT, 3, 0, most=10), "interval_seconds": Rule(_NUMBER, 1, 0), "max_calls": Rule(_COUNT, 1_000, 1),
        "reasoning_effort": Rule((str, type(None)), None),
    },
}
#: The keys of a label.
LABEL = {"description": Rule(_TEXT), "requires_before_cutoff": Rule(_FLAG, False), "conclusive": Rule(_FLAG, True)}


def _block(name: str, rules: dict[str, Rule], given: Any) -> Any:
    """A frozen record of a block; every fault is told with its place."""
    given = {} if given is None else given
    if not isinstance(given, dict):
        raise ValueError(f"{name}: not a block")
    if unknown := sorted(set(given) - set(rules)):
        raise ValueError(f"{name}: unknown keys {unknown}")
    values = {}
    for key, rule in rules.items():
        value = given.get(key, rule.default)
        size = len(value) if isinstance(value, list) else value
        if value is ...:
            raise ValueError(f"{name}.{key}: missing")
        if not isinstance(value, rule.kinds) or isinstance(value, bool) and bool not in rule.kinds:
            raise ValueError(f"{name}.{key}: not {' or '.join(k.__name__ for k in rule.kinds)}")
        if rule.one_of and value not in rule.one_of or rule.least is not None and size < rule.least or rule.above is not None and size <= rule.above or rule.most is not None and size > rule.most:
            raise ValueError(f"{name}.{key}: {value!r} is out of bounds")
        values[key] = value
    return make_dataclass(name, list(values), frozen=True)(**values)


@dataclass(frozen=True)
class Config:
    """``research`` must be given; the other blocks take their defaults where they are left out."""

    research: Any
    discovery: Any = field(default=None)
    network: Any = field(default=None)
    extraction: Any = field(default=None)
    llm: Any = field(default=None)


def check(given: dict) -> Config:
    """A checked configuration; raises ``ValueError`` for unknown keys, wrong kinds, values out of bounds and contradictions."""
    if not isinstance(given, dict) or set(given) - set(BLOCKS):
        raise ValueError(f"configuration: unknown blocks {sorted(set(given or ()) - set(BLOCKS))}")
    config = Config(**{name: _block(name, rules, given.get(name)) for name, rules in BLOCKS.items()})
    r, labels = config.research, {}
    for name, label in r.labels.items():
        labels[name] = _block(f"research.labels.{name}", LABEL, {"description": label} if isinstance(label, str) else label)
    cutoff = r.cutoff
    if isinstance(cutoff, str):
        cutoff = date.fromisoformat(cutoff)
    contradictions = {
        "research.unknown_label: not among the labels": r.unknown_label not in labels,
        "research.unknown_label: is conclusive": r.unknown_label in labels and labels[r.unknown_label].conclusive,
        "research.labels: Review is reserved for conflicts": "Review" in labels,
        "research.cutoff: missing, though a label depends on it": cutoff is None and any(x.requires_before_cutoff for x in labels.values()),
        "extraction.overlap_chars: not smaller than chunk_chars": config.extraction.overlap_chars >= config.extraction.chunk_chars,
    }
    if faults := [fault for fault, holds in contradictions.items() if holds]:
        raise ValueError("; ".join(faults))
    object.__setattr__(r, "labels", labels)
    object.__setattr__(r, "cutoff", cutoff)
    return config


def load(path: str) -> Config:
    """:func:`check` of a YAML or JSON file."""
    return check(read_config(path))
