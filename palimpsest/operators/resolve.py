"""Two-level overlap resolution inside a row.

First, connected spans of one entity become one logical detection; then connected detections of any
entities become one region, which the strictest action owns. Both cut sorted span arrays of a segment where a
span starts at or after all ends before it, so resolution needs no shuffle and no join, and long arrays cost little
more than their length. Touching spans do not connect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog
from ..functions.literals import mapping
from ..functions.spans import distinct, grouped, let, running
from ..policy import Policy

LOGICAL = "struct<entity_type:string,start:int,end:int,score:double,source:string,owner_width:int>"


def action_of(policy: Policy, entity: Column) -> Column:
    """The configured action of an entity, or the default (a literal map: policies are small)."""
    table = {e.entity_type: e.action for e in policy.entity_policies}
    default = F.lit(policy.default_action)
    return F.coalesce(F.element_at(mapping(table), entity), default) if table else default


def effective_action(policy: Policy, entity: Column, mcp: Column) -> Column:
    """The action that holds: a tool request has no other route, so reroute blocks."""
    action = action_of(policy, entity)
    return F.when(mcp & (action == "reroute"), "block").otherwise(action)


def route_of(policy: Policy, entity: Column) -> Column:
    """Route of a rerouted entity, or the default target."""
    table = {e.entity_type: e.route_class for e in policy.entity_policies if e.route_class}
    default = F.lit(policy.default_target)
    return F.coalesce(F.element_at(mapping(table), entity), default) if table else default


def strictness_of(action: Column) -> Column:
    """Rank of an action, 1 (pass) to 9 (block)."""
    return F.element_at(mapping(catalog.STRICTNESS), action)


def logical(spans: Column) -> Column:
    """Logical detections: union of connected spans of one entity, owned by the widest (then best scored) of them."""
    keyed = distinct(F.transform(spans, lambda s: F.struct(s.entity_type.alias("e"), s.start.alias("a"), s.end.alias("b"), (-s.score).alias("d"), s.source.alias("src"))))

    def connected(items: Column) -> Column:
        # the latest end so far of the entity at hand: entities come one after another
        reach = running(F.transform(items, lambda s: F.struct(s.e.alias("e"), s.b.alias("b"))), F.lit(None), "struct<e:string,b:int>", F.greatest)
        return let(reach, lambda r: grouped(items, lambda all_, i: (F.get(r, i).e != F.get(all_, i).e) | (F.get(all_, i).a >= F.get(r, i).b)))

    def one(g: Column) -> Column:
        owner = F.array_min(F.transform(g, lambda s: F.struct((s.a - s.b).alias("w"), s.d.alias("d"), s.src.alias("src"), s.a.alias("a"), s.b.alias("b"))))
        return F.struct(
            g[0].a.alias("start"), F.array_max(F.transform(g, lambda s: s.b)).alias("end"), g[0].e.alias("entity_type"), (-owner.d).alias("score"), owner.src.alias("source"), (-owner.w).alias("owner_width")
        )

    out = F.array_sort(F.transform(let(keyed, connected), one))
    found = F.transform(out, lambda g: F.struct(g.entity_type.alias("entity_type"), g.start.alias("start"), g.end.alias("end"), g.score.alias("score"), g.source.alias("source"), g.owner_width.alias("owner_width")))
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast(f"array<{LOGICAL}>"))


REGION = "struct<entity_type:string,start:int,end:int,score:double,source:string,action:string,members:array<string>,overlap:boolean,size:int>"


def regions(detections: Column, policy: Policy, mcp: Column) -> Column:
    """Regions: connected detections, with the winner's entity, score, source and action, the entities inside, whether they differ, and how many detections (in their order) there are."""
    keyed = lambda found: F.array_sort(F.transform(found, lambda d: F.struct(d.start.alias("a"), d.end.alias("b"), d.entity_type.alias("e"), d.source.alias("s"), d.alias("d"))))

    def connected(items: Column) -> Column:
        reach = running(F.transform(items, lambda k: k.b), F.lit(None), "int", F.greatest)
        return let(reach, lambda r: grouped(items, lambda all_, i: F.get(all_, i).a >= F.get(r, i)))

    def resolved(g: Column) -> Column:
        rank = lambda k: F.struct(
            (-strictness_of(effective_action(policy, k.d.entity_type, mcp))).alias("r"), (-k.d.owner_width).alias("w"), (-k.d.score).alias("d"),
            k.d.entity_type.alias("entity_type"), k.d.source.alias("source"), k.d.start.alias("a"), k.d.end.alias("b"),
        )
        winner = F.array_min(F.transform(g, rank))
        inside = F.array_sort(F.array_distinct(F.transform(g, lambda k: k.d.entity_type)))
        return let(winner, lambda w: F.struct(
            w.entity_type.alias("entity_type"), g[0].a.alias("start"), F.array_max(F.transform(g, lambda k: k.b)).alias("end"), (-w.d).alias("score"), w.source.alias("source"),
            effective_action(policy, w.entity_type, mcp).alias("action"), inside.alias("members"), (F.size(inside) > 1).alias("overlap"), F.size(g).alias("size"),
        ))

    # the detections are worked out once, however long their expression is
    return let(detections, lambda found: F.when(F.size(found) > 0, F.transform(let(keyed(found), connected), resolved)).otherwise(F.array().cast(f"array<{REGION}>")))
