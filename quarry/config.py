"""Settings: environment knobs with their defaults, and the sources file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

import yaml

STARTER = "# repos: [path, ...]\n# sources: [{type: memory, glob: ~/notes/**/*.md}]\n# code_globs: [~/bin/*.sh]\nrepos: []\nsources: []\ncode_globs: []\n"


def _on(value: str) -> bool:
    return value.lower() in ("on", "1", "true")


def purpose_types(value: str) -> tuple[str, ...]:
    """Types that get a purpose chunk: none, both, or those named."""
    v = value.strip().lower()
    if v in ("", "0", "off", "false"):
        return ()
    if v in ("1", "on", "true", "both"):
        return ("memory", "skills")
    return tuple(t for t in (x.strip() for x in v.split(",")) if t in ("memory", "skills"))


def names(value: str) -> tuple[str, ...]:
    return tuple(t for t in (x.strip() for x in value.split(",")) if t)


@dataclass(frozen=True)
class Settings:
    """All that changes results. from_env reads the knobs by their names."""

    home: str = "~/.quarry"
    dim: int = 384
    model: str = ""
    rerank_model: str = ""
    bm25_weight: float = 1.5
    rrf_k: int = 60
    recency_weight: float = 0.0
    recency_days: int = 90
    hybrid: bool = True
    rerank: bool = False
    rerank_auto: bool = True
    rerank_threshold: float = 0.35
    rerank_margin: float = 0.08
    code_rerank: bool = False
    query_log: bool = False
    purpose_chunk: tuple[str, ...] = ()
    card_only: tuple[str, ...] = ("handoffs",)
    card_paths: tuple[str, ...] = ()
    knowledge_scope: tuple[str, ...] = ("memory", "standards", "plans", "handoffs", "adrs")
    repos: tuple[str, ...] = ()
    sources: tuple[tuple[str, str], ...] = ()
    code_globs: tuple[str, ...] = field(default=())

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        e = dict(os.environ if env is None else env)
        get = lambda k, d: e.get(f"RAG_{k}", d)
        home = get("HOME", "~/.quarry")
        found = load_sources(Path(expand(get("SOURCES", f"{home}/sources.yaml")))) if "RAG_SOURCES" in e or "RAG_HOME" in e else {}
        return Settings(
            home=home, dim=int(get("DIM", "384")), model=get("MODEL", ""), rerank_model=get("RERANK_MODEL", ""), bm25_weight=float(get("BM25_WEIGHT", "1.5")), recency_weight=float(get("RECENCY_WEIGHT", "0")),
            hybrid=get("HYBRID", "1") not in ("0", "off", "false"), rerank=_on(get("RERANK", "off")), rerank_auto=_on(get("RERANK_AUTO", "on")),
            rerank_threshold=float(get("RERANK_AUTO_THRESHOLD", "0.35")), rerank_margin=float(get("RERANK_AUTO_MARGIN", "0.08")), code_rerank=_on(get("CODE_RERANK", "off")),
            query_log=_on(get("QLOG", "off")), purpose_chunk=purpose_types(get("PURPOSE_CHUNK", "off")), card_only=names(get("CARD_ONLY", "handoffs")),
            card_paths=tuple(p.lower() for p in names(get("CARD_PATHS", ""))), knowledge_scope=names(get("KNOWLEDGE_SCOPE", "memory,standards,plans,handoffs,adrs")),
            repos=tuple(expand(r) for r in found.get("repos") or []), sources=tuple((s["type"], expand(s["glob"])) for s in found.get("sources") or []),
            code_globs=tuple(expand(g) for g in found.get("code_globs") or []),
        )


def expand(path: str) -> str:
    return os.path.expandvars(os.path.expanduser(path))


def load_sources(path: Path) -> dict:
    """The sources file as a mapping. A missing file is written with a starter and counts as empty; any other content is an error."""
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(STARTER)
        return {}
    try:
        found = yaml.safe_load(path.read_text())
    except yaml.YAMLError as e:
        raise SystemExit(f"{path}: not YAML: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise SystemExit(f"{path}: a mapping is needed")
    return found
