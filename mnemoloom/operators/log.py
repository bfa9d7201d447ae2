"""The append-only event log: active runs, ordered folds into state, rollback.

State is a pure function of the active log. What each claim, edge or set ends up as needs no order but "first", "last" and
"sum", and is a plain aggregate. Concept membership depends on the interplay of create, attach, merge, split and prune, and
is folded user by user in the order of ``seq``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUPPORT, ECHO = 0.5, 0.25
LOG_SCHEMA = "seq bigint, user_id string, ts string, run_id string, type string, payload string"


def active(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Events whose run wasn't rolled back; events of no run always count."""
    back = runs.where("status = 'rolled_back'").select("run_id").distinct()
    return log.join(back, "run_id", "left_anti")


def events_since(log: DataFrame, runs: DataFrame, seq: int, user: str | None = None, types: list[str] | None = None, include_rolled_back: bool = False) -> DataFrame:
    out = log if include_rolled_back else active(log, runs)
    out = out.where(F.col("seq") > seq)
    if user is not None:
        out = out.where(F.col("user_id") == user)
    return out.where(F.col("type").isin(types)) if types else out


def append(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New events numbered after the log's greatest seq, in the given order.

    Numbers come from range partitions: rows before a row's partition, plus its place in it. Only counts are gathered.
    """
    from pyspark.sql import Window

    from mnemoloom.session import stash

    top = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    ranged = stash(new.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "append")
    counts = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, base = top, {}
    for p in sorted(counts):
        base[p], before = before, before + counts[p]
    start = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in base for x in (p, base[p])]), F.col("__p")), F.lit(top)) if base else F.lit(top)
    w = Window.partitionBy("__p").orderBy(*order)
    return ranged.withColumn("seq", start + F.row_number().over(w)).drop("__p")


def claim_state(events: DataFrame) -> DataFrame:
    """(user_id, claim_id, strength, last_seq): 1 at first sight, more for each support and echo, forgotten by a later prune.

    ``events`` has columns seq, user_id, type, claim_id.
    """
    gone = events.where("type = 'PRUNED'").groupBy("user_id", "claim_id").agg(F.max("seq").alias("gone"))
    live = events.where("type <> 'PRUNED'").join(gone, ["user_id", "claim_id"], "left").where("gone is null or seq > gone")
    born = live.where("type = 'NEW'").groupBy("user_id", "claim_id").agg(F.min("seq").alias("born"))
    rest = live.join(born, ["user_id", "claim_id"]).where("seq >= born")
    delta = F.when(F.col("seq") == F.col("born"), 1.0).when(F.col("type") == "SUPPORT", SUPPORT).when(F.col("type") == "STRENGTHENED", ECHO).otherwise(0.0)
    return rest.groupBy("user_id", "claim_id").agg(F.sum(delta).alias("strength"), F.max("seq").alias("last_seq"))


class Memory:
    """Everything derived for one user while events apply in order."""

    def __init__(self):
        self.members: dict[str, dict[str, str]] = {}
        self.label: dict[str, str] = {}
        self.state: dict[str, str] = {}
        self.strength: dict[str, float] = {}
        self.background: dict[str, int] = {}
        self.version: dict[str, dict] = {}
        self.relations: dict[tuple[str, str, str], float] = {}
        self.fragments: dict[str, dict] = {}
        self.queries: dict[str, list[str]] = {}

    def _add(self, concept: str, claims: list[str], kind: str = "primary") -> None:
        held = self.members.setdefault(concept, {})
        for c in claims:
            if kind == "primary" or c not in held:  # a primary place always wins
                held[c] = kind

    def apply(self, type_: str, p: dict) -> None:
        """One event; types that materialise nothing, and unknown ones, change nothing."""
        if f := getattr(self, f"_{type_.lower()}", None):
            f(p)

    def _canonicalized(self, p: dict) -> None:
        if p.get("action") == "new":
            self.strength.setdefault(p["claim_id"], 1.0)
        elif p["claim_id"] in self.strength:
            self.strength[p["claim_id"]] += SUPPORT

    def _strengthened(self, p: dict) -> None:
        if p.get("claim_id") in self.strength:
            self.strength[p["claim_id"]] += p.get("delta", ECHO)

    def _fragmented(self, p: dict) -> None:
        for f in p.get("fragments", []):
            self.fragments.setdefault(f["frag_id"], {"cluster": f.get("cluster"), "strength": f.get("strength", 1.0)})
        for anchor in p.get("reinforced", []):
            if anchor in self.fragments:
                self.fragments[anchor]["strength"] += ECHO

    def _reclustered(self, p: dict) -> None:
        for f, concept in p.get("assignments", {}).items():
            if f in self.fragments:
                self.fragments[f]["cluster"] = concept

    def _concept_created(self, p: dict) -> None:
        self.members.setdefault(p["concept_id"], {})
        self.label.setdefault(p["concept_id"], p.get("label", ""))
        self.state.setdefault(p["concept_id"], "active")
        self._add(p["concept_id"], p.get("claim_ids", []))

    def _attached(self, p: dict) -> None:
        if p["concept_id"] in self.members:
            self._add(p["concept_id"], p.get("claim_ids", []))

    def _merged(self, p: dict) -> None:
        if p["winner_id"] not in self.members:
            return
        loser = self.members.get(p["loser_id"], {})
        fold = [c for c in p.get("fold_claim_ids", list(loser)) if c in loser]
        self._add(p["winner_id"], fold)
        for c in fold:
            loser.pop(c, None)
        if p.get("label"):
            self.label[p["winner_id"]] = p["label"]
        if not p.get("kept_claim_ids"):
            self.members.pop(p["loser_id"], None)

    def _split(self, p: dict) -> None:
        self.members.pop(p["concept_id"], None)
        for child in p.get("into", []):
            self._concept_created(child)

    def _related(self, p: dict) -> None:
        self.relations[p["from_id"], p["to_id"], p["relation"]] = p.get("weight", 1.0)

    def _decayed(self, p: dict) -> None:
        if p.get("concept_id") in self.members:
            self.state[p["concept_id"]] = p["state_to"]

    def _backgrounded(self, p: dict, flag: int = 1) -> None:
        if p["claim_id"] in self.strength:
            self.background[p["claim_id"]] = flag

    def _unbackgrounded(self, p: dict) -> None:
        self._backgrounded(p, 0)

    def _versioned(self, p: dict) -> None:
        for end in ("current", "other"):
            if p.get(f"{end}_id") in self.strength:
                status = "version" if p["mode"] == "version" else "scoped" if p["mode"] == "scope" else "current" if end == "current" else "superseded"
                self.version[p[f"{end}_id"]] = {"group": p["version_group"], "status": status, "qualifier": p.get(f"qualifier_{end}")}

    def _pruned(self, p: dict) -> None:
        claim = p["claim_id"]
        self.members.get(p["concept_id"], {}).pop(claim, None)
        if not any(held.get(claim) == "primary" for held in self.members.values()):
            for of in (self.strength, self.background, self.version):
                of.pop(claim, None)

    def _channel_redundancy(self, p: dict) -> None:
        self._replace("redundant", p.get("pairs", {}))

    def _query_injected(self, p: dict) -> None:
        self.queries = {q["id"]: q.get("text", "") for q in p.get("queries", [])}
        self._replace("query", {q["id"]: q.get("concept_ids", []) for q in p.get("queries", [])})

    def _replace(self, kind: str, pairs: dict[str, list[str]]) -> None:
        """All members of one kind become ``pairs``, claim to concepts."""
        for held in self.members.values():
            for c in [c for c, k in held.items() if k == kind]:
                del held[c]
        for claim, concepts in pairs.items():
            for concept in concepts:
                if concept in self.members:
                    self._add(concept, [claim], kind)

    def rows(self) -> list[tuple]:
        """(concept_id, label, state, claim_id, kind) of all members."""
        return [(k, self.label.get(k, ""), self.state.get(k, "active"), c, kind) for k in sorted(self.members) for c, kind in sorted(self.members[k].items())]

    def entities(self) -> list[tuple]:
        """(entity, id, ref, value, detail) of everything."""
        out: list[tuple] = [("concept", k, self.state.get(k, "active"), float(len(self.members[k])), self.label.get(k, "")) for k in sorted(self.members)]
        out += [("member", k, c, None, kind) for k in sorted(self.members) for c, kind in sorted(self.members[k].items())]
        for c in sorted(self.strength):
            v = self.version.get(c, {})
            detail = ",".join(filter(None, ["background" if self.background.get(c) else "", v.get("status"), v.get("qualifier")]))
            out.append(("claim", c, v.get("group"), self.strength[c], detail))
        out += [("relation", a, b, w, r) for (a, b, r), w in sorted(self.relations.items())]
        out += [("fragment", f, x["cluster"], x["strength"], None) for f, x in sorted(self.fragments.items())]
        return out + [("query", q, None, None, text) for q, text in sorted(self.queries.items())]


def _fold(log: DataFrame, runs: DataFrame, columns: list[str], kinds: str, rows) -> DataFrame:
    """The active log folded by user, users in parallel, each in the order of seq."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        state = Memory()
        for type_, payload in frame.sort_values("seq", kind="stable")[["type", "payload"]].itertuples(index=False):
            state.apply(type_, json.loads(payload) if payload else {})
        return pd.DataFrame(rows(state), columns=columns).assign(user_id=frame["user_id"].iloc[0])[["user_id", *columns]]

    kept = active(log, runs).select("seq", "user_id", "type", "payload")
    return kept.groupBy("user_id").applyInPandas(fold, f"user_id string, {kinds}")


def rebuild(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_id, concept_id, label, state, claim_id, kind) of all members by the active log."""
    columns = ["concept_id", "label", "state", "claim_id", "kind"]
    return _fold(log, runs, columns, ", ".join(f"{c} string" for c in columns), Memory.rows)


def rebuild_all(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_id, entity, id, ref, value, detail): concepts, members, claims, relations, fragments and query-claims by the active log."""
    return _fold(log, runs, ["entity", "id", "ref", "value", "detail"], "entity string, id string, ref string, value double, detail string", Memory.entities)


def relation_state(events: DataFrame) -> DataFrame:
    """(user_id, from_id, to_id, relation, weight): the last weight of each relation; plain aggregates of (seq, .., weight)."""
    return events.groupBy("user_id", "from_id", "to_id", "relation").agg(F.max_by("weight", "seq").alias("weight"))


def flag_state(events: DataFrame) -> DataFrame:
    """(user_id, claim_id, background): the last flag of each claim, of events (seq, user_id, type, claim_id)."""
    flags = events.where(F.col("type").isin("BACKGROUNDED", "UNBACKGROUNDED"))
    return flags.groupBy("user_id", "claim_id").agg(F.max_by(F.when(F.col("type") == "BACKGROUNDED", 1).otherwise(0), "seq").alias("background"))


def roll_back(runs: DataFrame, run_id: str) -> DataFrame:
    """The run ledger with one run rolled back; state follows by rebuilding."""
    return runs.withColumn("status", F.when(F.col("run_id") == run_id, "rolled_back").otherwise(F.col("status")))


def orphans(members: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims that no concept holds: what splits and prunes left behind."""
    return claims.join(members.where("kind = 'primary'").select("claim_id").distinct(), "claim_id", "left_anti")


def dangling(relations: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges with an end that exists no more."""
    known = nodes.select(F.col(node).alias("__n"))
    both = relations.join(known, F.col("from_id") == F.col("__n"), "left_semi").join(known, F.col("to_id") == F.col("__n"), "left_semi")
    return relations.join(both.select("from_id", "to_id", "relation"), ["from_id", "to_id", "relation"], "left_anti")
