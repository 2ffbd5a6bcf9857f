"""A graph as a self-contained HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

_PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:1em}}li span{{color:#666}}</style>
<h1>{title}</h1><input id="q" placeholder="filter nodes"><ul id="list"></ul>
<script>
const nodes = {nodes}, edges = {edges}, list = document.getElementById("list");
function show(q) {{
  list.replaceChildren(...nodes.filter(n => n.label.includes(q)).map(n => {{
    const li = document.createElement("li"), out = edges.filter(e => e.src === n.label);
    li.title = n.title; li.textContent = n.label + " ";
    const s = document.createElement("span"); s.textContent = out.map(e => e.label + " \\u2192 " + e.dst).join("; ");
    li.append(s); return li;
  }}));
}}
document.getElementById("q").addEventListener("input", e => show(e.target.value)); show("");
</script>
"""


def graph_page(nodes: DataFrame, edges: DataFrame, title: str) -> str:
    """HTML of a drawn graph's nodes(label, title) and edges(src, dst, label); for graphs a person can read."""
    packed = lambda df: json.dumps([r.asDict() for r in df.orderBy(*df.columns).collect()]).replace("</", "<\\/")
    return _PAGE.format(title=html.escape(title), nodes=packed(nodes), edges=packed(edges))
