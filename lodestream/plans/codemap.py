"""The map of a code base: file types, communities, hubs and links to documents, rendered as text.

A map covers one project, whose files ``sources.files`` bounds; its tables are small and end on the driver.
"""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.operators import codegraph, docgraph, largegraph
from lodestream.sources import files

CACHE = "codebase-map.json"
FILES_SHOWN, LINKS_SHOWN, HUBS_SHOWN, ENDINGS_SHOWN, FOUND_SHOWN, TOPICS_SHOWN = 4, 15, 10, 4, 10, 20


def inside(path: str, root: str) -> Path:
    """The resolved path, which has to lie below the root."""
    resolved = Path(path).resolve()
    if not resolved.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} lies outside {root}")
    return resolved


def commit_of(path: Path) -> str | None:
    """The checked-out commit, or None where there is none."""
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], cwd=path, capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return found.stdout.strip() if found.returncode == 0 else None


def _listed(rows: DataFrame, *columns: str) -> tuple[list[dict], int]:
    """The first rows by path, as many as are shown, and the number of all."""
    shown = rows.select(*columns).orderBy("path").limit(FOUND_SHOWN).collect()
    return [r.asDict() for r in shown], rows.count()


def build(sources: DataFrame, documents: DataFrame | None = None, types: DataFrame | None = None, doc_edges: DataFrame | None = None) -> dict:
    """Counts, communities, hubs and cross-links of (path, source) files and document chunks.

    ``types`` (path, group, label, is_text) are a detector's: they tell binaries from texts, and
    texts that aren't what their ending says. ``doc_edges`` (src, dst) is the documents' graph.
    """
    counts, entries = files.inventory(sources.select("path"))
    if types is not None:
        entries = files.detected(entries.select("path"), types)
        counts = entries.groupBy("content_type").agg(F.count("*").alias("n"))
    entries = entries.cache()
    endings = entries.select("content_type", files.suffix(F.col("path")).alias("end")).where(F.length("end") > 1).groupBy("content_type").agg(F.slice(F.array_sort(F.collect_set("end")), 1, ENDINGS_SHOWN).alias("ends"))
    label = F.split_part("content_type", F.lit("/"), F.lit(2)).alias("label")
    binaries, all_binaries = _listed(entries.where(~F.col("is_text")).withColumn("label", label), "path", "label")
    wrong, all_wrong = ([], 0) if types is None else _listed(files.mismatches(entries), "path", "found")
    code = entries.where(F.startswith("content_type", F.lit("code/"))).join(sources, "path").withColumn("language", F.split_part("content_type", F.lit("/"), F.lit(2)))
    extracted = codegraph.extract(code).cache()
    imports = codegraph.import_edges(extracted)
    edges = imports.unionByName(codegraph.inheritance_edges(extracted, imports)).cache()
    nodes = extracted.select(F.col("path").alias("node"))
    graph = edges.select(F.lit(0).alias("graph"), "src", "dst").unionByName(nodes.select(F.lit(0).alias("graph"), F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))
    members = codegraph.communities(graph).cache()
    inner = {r.community: r.edge_count for r in codegraph.internal_edges(edges, members).collect()}
    groups = members.groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("files")).orderBy(F.desc(F.size("files")), "community").collect()
    stem = lambda p: Path(p).stem
    communities = [{"label": "/".join(map(stem, g.files[:3])), "files": g.files, "edges": inner.get(g.community, 0)} for g in groups]
    hubs = codegraph.hubs(codegraph.in_degrees(nodes, edges)).orderBy(F.desc("in_degree"), "node").collect()
    found = None if documents is None else docgraph.cross_links(extracted.select("path", "exports"), documents).cache()
    links = [] if found is None else found.orderBy("relation", "code", "doc").limit(LINKS_SHOWN).collect()  # documents are no bounded side
    topics = []
    if documents is not None and doc_edges is not None:
        topic = largegraph.communities(doc_edges, documents.select(F.col("chunk_id").alias("node"))).withColumnRenamed("node", "chunk_id")
        named = docgraph.representative_category(topic.join(documents.select("chunk_id", "category"), "chunk_id"))
        sizes = topic.groupBy("community").agg(F.count("*").alias("chunks")).join(named, "community", "left")
        topics = [r.asDict() for r in sizes.orderBy("community").limit(TOPICS_SHOWN).collect()]
    return {
        "endings": {r.content_type: r.ends for r in endings.collect()}, "binaries": binaries, "all_binaries": all_binaries, "mismatches": wrong, "all_mismatches": all_wrong, "topics": topics,
        "types": {r.content_type: r.n for r in counts.orderBy(F.desc("n"), "content_type").collect()}, "communities": communities,
        "hubs": [{"file": h.node, "in_degree": h.in_degree} for h in hubs], "cross_links": [{"code": x.code, "doc": str(x.doc), "relation": x.relation} for x in links], "all_links": 0 if found is None else found.count(),
    }


def render(found: dict) -> str:
    """Markdown, with long lists cut."""
    more = lambda rows, n: [f"- and {n - len(rows)} more"] if n > len(rows) else []
    ends = lambda t: f" ({', '.join('*' + x for x in e)})" if (e := found.get("endings", {}).get(t)) else ""
    lines = ["# Codebase map", "", "## File types", *(f"- {t}: {n}{ends(t)}" for t, n in found["types"].items())]
    if rows := found.get("binaries"):
        lines += ["", "### Binary files", *(f"- {x['path']} ({x['label']})" for x in rows), *more(rows, found["all_binaries"])]
    if rows := found.get("mismatches"):
        lines += ["", "### Not what the ending says", *(f"- {x['path']}: {x['found']}" for x in rows), *more(rows, found["all_mismatches"])]
    if found["communities"]:
        lines += ["", "## Code communities"]
        for c in found["communities"]:
            rest = f", and {len(c['files']) - FILES_SHOWN} more" if len(c["files"]) > FILES_SHOWN else ""
            lines.append(f"- {c['label']} ({len(c['files'])} files, {c['edges']} edges): {', '.join(c['files'][:FILES_SHOWN])}{rest}")
    if found.get("topics"):
        lines += ["", "## Document communities", *(f"- {x['category'] or 'Topic ' + str(x['community'] + 1)} ({x['chunks']} chunks)" for x in found["topics"])]
    if found["hubs"]:
        lines += ["", "## Hubs", *(f"- {h['file']} (imported by {h['in_degree']})" for h in found["hubs"][:HUBS_SHOWN])]
    if found["cross_links"]:
        rest = found.get("all_links", 0) - LINKS_SHOWN
        lines += ["", "## Cross-links", *(f"- {x['code']} - {x['doc']} ({x['relation']})" for x in found["cross_links"][:LINKS_SHOWN]), *([f"- and {rest} more"] if rest > 0 else [])]
    return "\n".join(lines)


def map_of(spark: SparkSession, path: str, root: str = ".", refresh: bool = False, documents: DataFrame | None = None, cache_dir: str = ".lodestream") -> str:
    """The rendered map of a project folder; cached by commit, rebuilt if the cache is damaged or of another commit."""
    project = inside(path, root)
    commit, cache = commit_of(project), project / cache_dir / CACHE
    if commit and cache.exists() and not refresh:
        try:
            held = json.loads(cache.read_text())
            if held["commit"] == commit:
                return render(held["map"])
        except (ValueError, KeyError):
            pass
    found = files.discover(spark, project.as_uri()).where(F.col("size") <= files.MAX_HASHED)
    sources = found.select(F.col("relative").alias("path"), F.decode(F.col("content"), "UTF-8").alias("source"))
    built = build(sources, documents)
    if commit:
        cache.parent.mkdir(exist_ok=True)
        cache.write_text(json.dumps({"commit": commit, "map": built}))
    return render(built)
