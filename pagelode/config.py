"""Parameters of the engine. All of them can be given; these are the usual ones."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scope:
    """Hosts that a crawl may enter: host suffixes, and IPv4 ranges in CIDR form."""

    suffixes: tuple[str, ...] = (".example.org", ".example.net")
    ipv4_ranges: tuple[str, ...] = ("172.20.0.0/14",)


@dataclass(frozen=True)
class Config:
    # Field weights, in the order in which a page's fields are indexed; others weigh 1.
    field_weights: dict[str, float] = field(default_factory=lambda: {"url": 3.0, "title": 5.0, "body": 1.0, "headings": 2.0})
    max_positions: int = 100
    # Relevance and fusion.
    k1: float = 1.5
    b: float = 0.75
    relevance_weight: float = 0.7
    authority_weight: float = 0.3
    # Link analysis.
    damping: float = 0.85
    max_iterations: int = 100
    tolerance: float = 1e-6
    # Results.
    default_limit: int = 20
    max_limit: int = 100
    snippet_length: int = 200
    snippet_lead: int = 50
    # Crawling.
    max_depth: int = 10
    max_page_bytes: int = 10 * 1024 * 1024
    max_anchor: int = 200
    host_concurrency: int = 3
    host_delay_seconds: float = 1.0
    retry_step_seconds: int = 300
    seed_priority: int = 1
    link_priority: int = 5
    scope: Scope = field(default_factory=Scope)


DEFAULT = Config()
