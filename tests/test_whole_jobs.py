"""Queries that do the whole job where an older one is bound to a smaller SQL."""

from collections import defaultdict

import pyarrow.parquet as pq

from tarnwork.plans import registry


def test_collapse_covers_every_row(spark, data):
    t = pq.read_table(f"{data}/ctd_relations.parquet", columns=["symptom", "stitch_flat_id", "chemical_mesh_id", "chemical_match_method"]).to_pylist()
    by = defaultdict(dict)
    for r in t:
        if r["stitch_flat_id"] is not None and r["chemical_mesh_id"] is not None:
            first = r["chemical_match_method"] != "ctd_chemical_name"
            v = r["stitch_flat_id"]
            by[r["symptom"]][v] = min(first, by[r["symptom"]].get(v, True))
    want = set()
    for k, values in by.items():
        chosen = min(values, key=lambda v: (values[v], v))
        want.add((k, chosen, ";".join(sorted(v for v in values if v != chosen))))
    got = {(r["symptom"], r["chosen"], r["others"]) for r in registry.queries()["v_collapse"](spark, data).collect()}
    assert got == want


def test_clusters_link_by_up_to_nineteen_members(spark, data):
    t = pq.read_table(f"{data}/reports.parquet", columns=["perturbation_type", "perturbation_id", "source_term_id"]).to_pylist()
    of, members = defaultdict(set), set()
    for r in t:
        if r["perturbation_type"] == "gene" and r["perturbation_id"] is not None:
            members.add(r["perturbation_id"])
            if r["source_term_id"] is not None:
                of[r["source_term_id"]].add(r["perturbation_id"])
    up = {m: m for m in members}

    def find(m):
        while up[m] != m:
            m = up[m]
        return m

    for linked in of.values():
        if len(linked) < 20:
            for m in linked:
                a, b = sorted((find(m), find(min(linked))))
                up[b] = a
    got = {r["perturbation_id"]: r["cluster"] for r in registry.queries()["g_clusters"](spark, data).collect()}
    assert got == {m: find(m) for m in members}
    assert any(2 < len(v) < 20 for v in of.values())
