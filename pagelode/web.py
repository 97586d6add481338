"""The engine over HTTP: a WSGI application with pages for people and JSON for programs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from html import escape
from urllib.parse import parse_qs, quote_plus

from pyspark.sql import DataFrame

from pagelode.config import DEFAULT, Config
from pagelode.operators import graph, pagerank, ranking, search
from pagelode.operators import index as ix
from pagelode.operators.index import Index


def stats(index: Index, pages: DataFrame, links: DataFrame) -> dict:
    """Figures of the index, the pages and the links."""
    return graph.engine_stats(ix.index_stats(index.postings, index.docs), pages, links).first().asDict()


def explained(index: Index, doc_id: str, text: str, config: Config = DEFAULT) -> dict | None:
    """How a document's score for a query comes about; None if the query has no terms."""
    terms = search.parse(index.docs.sparkSession, text)["terms"]
    if not terms:
        return None
    rows = [r.asDict() for r in ranking.explain(index, doc_id, terms, config).collect()]
    shared = ("total", "pagerank", "final")
    own = {k: rows[0][k] for k in shared} if rows else dict.fromkeys(shared, 0.0)
    return {"doc_id": doc_id, "terms": {r.pop("term"): {k: v for k, v in r.items() if k not in shared} for r in rows}, **own}


def _layout(title: str, body: str) -> str:
    form = '<form action="/search"><input name="q"> <button>Search</button></form>'
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><nav><a href=/>Search</a> <a href=/stats>Figures</a> <a href=/about>About</a></nav>{form}{body}"


def _snippet(text: str) -> str:
    """A snippet with nothing but its own marks."""
    return escape(text).replace("&lt;em&gt;", "<em>").replace("&lt;/em&gt;", "</em>")


def _results_page(answer: dict, limit: int, mode: str) -> str:
    asked = quote_plus(answer["query"])
    out = [f"<p>{answer['total']} pages with all terms, {answer['time_ms']:.1f} ms</p>"]
    if answer["corrected"]:
        out.append(f"<p>Shown for <b>{escape(answer['corrected'])}</b></p>")
    for r in answer["results"]:
        out.append(f"<h3><a href=\"{escape(r['url'] or '')}\">{escape(r['title'] or r['url'] or r['doc_id'])}</a></h3><p>{_snippet(r['snippet'])}</p><small>{r['final']:.4f} ({r['bm25']:.4f}, {r['pagerank']:.6f})</small>")
    for n in ranking.page_window(answer["total"], limit, (answer["page"] - 1) * limit):
        out.append(f"<b>{n}</b>" if n == answer["page"] else f'<a href="/search?q={asked}&page={n}&mode={mode}">{n}</a>')
    return "\n".join(out)


def create_app(index: Index | None, pages: DataFrame | None = None, links: DataFrame | None = None, config: Config = DEFAULT) -> Callable:
    """The application over an index, and over pages and links for figures. Without an index it answers with an error."""

    def number(values: dict, name: str, usual: int) -> int:
        try:
            return max(0, int(values.get(name, [usual])[0]))
        except ValueError:
            return usual

    def asked(values: dict) -> tuple[str, int, int, str]:
        limit = ranking.clamp(number(values, "limit", config.default_limit), config)
        offset = number(values, "offset", (max(1, number(values, "page", 1)) - 1) * limit)
        return values.get("q", [""])[0], limit, offset, values.get("mode", ["hybrid"])[0]

    def answer(path: str, values: dict) -> tuple[int, str, str]:
        text, limit, offset, mode = asked(values)
        as_json = lambda x: (200, "application/json", json.dumps(x, ensure_ascii=False, default=str))
        page = lambda title, body: (200, "text/html; charset=utf-8", _layout(title, body))
        if path == "/":
            return page("Search", "")
        if path == "/about":
            return page("About", f"<p>Results are ordered by {config.relevance_weight:g} relevance (BM25) and {config.authority_weight:g} authority (PageRank).</p>")
        if path == "/search":
            return page(text or "Search", _results_page(search.search(index, text, limit, offset, mode, config), limit, mode) if text.strip() else "")
        if path == "/api/search":
            return as_json(search.search(index, text, limit, offset, mode, config))
        if index is None:
            return 503, "application/json", json.dumps({"error": "index not loaded"})
        if path == "/api/explain":
            return as_json(explained(index, values.get("doc_id", [""])[0], text, config))
        if path in ("/api/stats", "/stats") and pages is not None and links is not None:
            figures = stats(index, pages, links)
            if path == "/api/stats":
                return as_json(figures)
            top = pagerank.titled(pages.selectExpr("doc_id", "pagerank AS rank"), pages, 10).collect() if "pagerank" in pages.columns else []
            rows = "".join(f"<tr><td>{k}<td>{v:.1f}" if isinstance(v, float) else f"<tr><td>{k}<td>{v}" for k, v in figures.items())
            return page("Figures", f"<table>{rows}</table><ol>{''.join(f'<li>{escape(r["title"] or r["url"])} {r["rank"]:.6f}' for r in top)}</ol>")
        return 404, "application/json", json.dumps({"error": "not found"})

    def app(environ: dict, start_response: Callable) -> Iterable[bytes]:
        code, kind, body = answer(environ.get("PATH_INFO", "/"), parse_qs(environ.get("QUERY_STRING", "")))
        data = body.encode()
        start_response({200: "200 OK", 404: "404 Not Found", 503: "503 Service Unavailable"}[code], [("Content-Type", kind), ("Content-Length", str(len(data)))])
        return [data]

    return app
