"""Checking again only what is out of date.

Each session that was checked leaves a stamp: the folder that its observations' bucket had, a fingerprint of
the observations, and one of what they were checked under (the pack, its settings and the session's rates).
A refresh opens the buckets of observations whose folder is new, fingerprints the sessions in them, and
checks the sessions of which a fingerprint differs; all others keep their rows, unread. Stamps are written
last, so a refresh that fails is done again by the next one, with the same rows.

Defined cases: a session whose rows were written again unchanged, in whatever order, is carried over; one
that has no observations any more goes from all tables; equal rows count as often as they come; columns
that are null say the same as columns that are missing; rates of other sessions change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.operators.findings import verify
from attest.operators.rules import RULES
from attest.plans.rulepack import RulePack
from attest.plans.settings import SETTING
from attest.sources.session import once
from attest.tables import SessionTable

STAMP = "session_id string, source string, content string, terms string"


@dataclass(frozen=True)
class Ledger:
    """The tables of a body of sessions: what was observed, what was made of it, and under which stamps."""

    observations: SessionTable
    nodes: SessionTable
    findings: SessionTable
    stamps: SessionTable

    @staticmethod
    def at(spark: SparkSession, path: str, buckets: int = 256) -> "Ledger":
        return Ledger(*[SessionTable(spark, f"{path}/{name}", buckets) for name in ("observations", "nodes", "findings", "stamps")])


def fingerprint(rows: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, content): a fingerprint of each group's rows that doesn't depend on their order.

    The sums of two hashes of each row as JSON, by names of columns, and the number of rows: 128 bits that
    are summed before the shuffle, so no group is gathered.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(set(rows.columns) - set(by))]), {"ignoreNullFields": "true"})
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(20,0)"))
    joined = F.concat_ws(":", total(1).cast("string"), total(2).cast("string"), F.count(F.lit(1)).cast("string"))
    return rows.groupBy(*by).agg(joined.alias("content"))


def _terms(sessions: DataFrame, rates: DataFrame, pack: RulePack, rules) -> DataFrame:
    """(session_id, terms): what sessions are checked under."""
    own = sessions.sparkSession.createDataFrame([], SETTING) if pack.own is None else pack.own
    mine = fingerprint(own.where("session_id is not null")).withColumnRenamed("content", "__own")
    shared = fingerprint(own.where("session_id is null").drop("session_id"), ()).first().content  # one row of three numbers
    money = fingerprint(rates).withColumnRenamed("content", "__rates")
    parts: list[Column] = [F.lit(repr((replace(pack, own=None), [r.__name__ for r in rules]))), F.lit(shared), F.coalesce("__own", F.lit("")), F.coalesce("__rates", F.lit(""))]
    got = sessions.join(mine, "session_id", "left").join(money, "session_id", "left")
    return got.select(*sessions.columns, F.sha2(F.concat_ws("|", *parts), 256).alias("terms"))


def refresh(ledger: Ledger, rates: DataFrame, pack: RulePack = RulePack(), rules=RULES) -> DataFrame:
    """Brings nodes and findings up to date; (session_id, action) of sessions that were checked, carried or removed.

    Sessions in buckets that didn't change are carried without being read, unless their terms changed.
    """
    known = ledger.stamps.read()
    known = once(ledger.stamps.spark.createDataFrame([], STAMP) if known is None else known.select(*STAMP.replace(" string", "").split(", ")))
    seen = {r.source for r in known.select("source").distinct().collect()}  # one folder a bucket
    rows, folders = ledger.observations.since(seen)
    now = known.join(folders, "source", "left_semi").select("session_id", "source", "content")
    if rows is not None:
        read = fingerprint(rows, ("session_id", "source"))
        now = now.unionByName(read)
    now = _terms(now, rates, pack, rules)
    old = known.select("session_id", *[F.col(c).alias(f"__{c}") for c in ("source", "content", "terms")])
    same = F.col("content").eqNullSafe(F.col("__content")) & F.col("terms").eqNullSafe(F.col("__terms"))
    action = F.when(F.col("content").isNull(), "removed").when(same, "carried").otherwise("checked")
    plan = once(now.join(old, "session_id", "full").withColumn("action", action))
    work, gone = plan.where("action = 'checked'").select("session_id"), plan.where("action = 'removed'").select("session_id")
    if not (work.isEmpty() and gone.isEmpty()):
        named = work.unionByName(gone)
        obs = ledger.observations.among(work)
        if obs is None:  # nothing is left to check, so what is gone is taken out
            for table in (ledger.nodes, ledger.findings):
                held = table.read()
                if held is not None:
                    table.replace(held.limit(0), named)
        else:
            n, f = verify(obs, rates.join(work, "session_id", "left_semi"), pack, rules)
            ledger.nodes.replace(n, named)
            ledger.findings.replace(once(f), named)
    moved = plan.where("action = 'checked' or (action = 'carried' and not source <=> __source)")
    if not (moved.isEmpty() and gone.isEmpty()):
        ledger.stamps.replace(moved.select(*STAMP.replace(" string", "").split(", ")), gone)
    return plan.select("session_id", "action")
