"""Identities kept up to date: new records are linked to the persons there are, whose keys stay."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from . import identity
from .graph import components
from .keys import dense_keys


@dataclass(frozen=True)
class State:
    """members: records with their match keys and person. persons: a row a person, before conflicts of tax ids are settled.
    aliases: (person_key, into) of keys that were given up when persons merged."""

    members: DataFrame
    persons: DataFrame
    aliases: DataFrame


def start(records: DataFrame) -> State:
    """The state after a whole run; identity.finished(state.members, state.persons) gives its results."""
    member, gold = identity.first_run(records)
    member, gold = saved(member, "members"), saved(gold, "persons")
    none = gold.select("person_key", F.col("person_key").alias("into")).where("false")
    return State(member, gold, none)


def new_links(member: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links (a, b, rule) of fresh records b to a: the person that has their rule group already, else the smallest fresh
    record of the group. The old records of a group are one person, so one label stands for all of them, and only old
    records that share a key with a fresh one are grouped."""
    found = []
    for name, condition, keys in identity.rules():
        rows = fresh.where(condition)
        hub = rows.groupBy(*keys).agg(F.min("node").alias("least"))
        named = hub.select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        old = member.where(condition).join(named, same, "left_semi").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("person").alias("old"))
        hub = hub.join(old, same, "left").select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce("old", "least").alias("a"))
        found.append(rows.join(hub, same).select("a", F.col("node").alias("b"), F.lit(name).alias("rule")).where("a <> b"))
    return reduce(DataFrame.unionByName, found)


def add(state: State, records: DataFrame) -> State:
    """The state with further records: the persons are those of a whole run over all records, but for their keys.

    Old persons are single nodes of the new graph, so its size is that of the new records and the persons they touch; only
    touched persons are made again, from their members. A person keeps its key; where persons merge the smallest of their
    keys stays and the others become aliases, of earlier aliases too. New persons are numbered after all keys ever given,
    in the order of a whole run. Records whose node is known already are left as they are, so a repeated load changes
    nothing. No new records give the same state.
    """
    fresh = saved(identity.nodes(records).join(state.members.select("node"), "node", "left_anti"), "nodes")
    edges = saved(new_links(state.members, fresh), "links")
    label = components(edges.select("a", "b"))
    moved = label.select(F.col("node").alias("person"), "component")

    relabelled = state.members.join(moved, "person", "left").withColumn("person", F.coalesce("component", "person")).drop("component")
    placed = fresh.join(label, "node", "left").withColumn("person", F.coalesce("component", "node")).drop("component")
    members = saved(relabelled.unionByName(placed), "members")

    before = saved(state.persons.join(moved, "person"), "touched")
    keys = before.groupBy(F.col("component").alias("person")).agg(F.min("person_key").alias("person_key"))
    touched = label.select(F.col("component").alias("person")).unionByName(placed.select("person")).distinct()
    theirs = members.join(touched, "person", "left_semi")
    new_rules = edges.select(F.col("a").alias("node"), "rule").join(label, "node").select(F.col("component").alias("person"), "rule")
    old_rules = before.where("rules IS NOT NULL").select(F.col("component").alias("person"), F.explode(F.split("rules", r"\+")).alias("rule"))

    made = saved(identity.grouped(theirs).join(keys, "person", "left"), "persons")
    given = state.persons.select("person_key").unionByName(state.aliases.select("person_key")).agg(F.coalesce(F.max("person_key"), F.lit(0)).alias("_last"))
    numbered = dense_keys(made.where("person_key IS NULL").drop("person_key"), identity.key_order(), "_nth").crossJoin(F.broadcast(given))  # one row
    numbered = numbered.withColumn("person_key", F.col("_last") + F.col("_nth")).drop("_last", "_nth")
    again = identity.described(made.where("person_key IS NOT NULL").unionByName(numbered), theirs, identity.rule_names(new_rules.unionByName(old_rules)))
    persons = saved(state.persons.join(moved, "person", "left_anti").unionByName(again), "persons")

    into = before.select(F.col("component").alias("person"), F.col("person_key").alias("was")).join(keys, "person").where("was <> person_key").select("was", F.col("person_key").alias("now"))
    earlier = state.aliases.join(into, F.col("into") == F.col("was"), "left").select("person_key", F.coalesce("now", "into").alias("into"))
    aliases = saved(earlier.unionByName(into.select(F.col("was").alias("person_key"), F.col("now").alias("into"))), "aliases")
    return State(members, persons, aliases)
