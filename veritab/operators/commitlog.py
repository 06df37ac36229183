"""Replay of the commitment log: versions, attestations, representations and roles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import ZERO_ROOT
from ..functions.ordered import RUN_LIMIT, Ordered, into_runs, largest_group
from ..session import pin


def _steps(calls: DataFrame) -> DataFrame:
    """Register and update calls with the version they need: 0 to register, null when void."""
    void = (F.col("object_root") == ZERO_ROOT) | (F.col("evidence_root") == ZERO_ROOT)
    needs = F.when(F.col("call") == "register", F.lit(0)).otherwise(F.col("expected_version"))
    return calls.filter(F.col("call").isin("register", "update")).withColumn("needs", F.when(~void, needs).cast("long"))


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Version before each call; rows come sorted by (object, run, seq). Memory is one version."""
    here, version = None, 0
    for batch in batches:
        befores = []
        for object_id, run, start, needs in zip(batch["object_id"], batch["run"], batch["start"], batch["needs"]):
            if (object_id, run) != here:
                here, version = (object_id, run), start
            befores.append(version)
            if needs == version:
                version += 1
        yield batch.assign(before=befores)[["object_id", "seq", "before"]]


def _run_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each start version ends after a run; rows come sorted by (object, run, seq descending)."""
    here, ends = None, {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame({
            "object_id": [here[0]] * len(ends), "run": [here[1]] * len(ends),
            "low": list(ends.keys()), "high": list(ends.values()),
        })

    for batch in batches:
        for object_id, run, needs in zip(batch["object_id"], batch["run"], batch["needs"]):
            if (object_id, run) != here:
                if here is not None:
                    yield rows()
                here, ends = (object_id, run), {}
            if needs == needs:
                ends[int(needs)] = ends.get(int(needs) + 1, int(needs) + 1)
    if here is not None:
        yield rows()


def _compose(maps: DataFrame) -> DataFrame:
    """Maps (object, block, low, high) of neighbouring blocks joined into one of half as many."""
    left = maps.filter(F.col("block") % 2 == 0)
    right = maps.filter(F.col("block") % 2 == 1)
    after = right.select("object_id", (F.col("block") - 1).alias("block"), F.col("low").alias("high"), F.col("high").alias("end"))
    through = left.join(after, ["object_id", "block", "high"], "left").select(
        "object_id", "block", "low", F.coalesce("end", "high").alias("high")
    )
    mine = right.withColumn("block", F.col("block") - 1)
    untouched = mine.join(left.select("object_id", "block", "low"), ["object_id", "block", "low"], "left_anti")
    return through.unionByName(untouched).withColumn("block", F.floor(F.col("block") / 2))


def _run_starts(runs: DataFrame) -> DataFrame:
    """Version each run of an object starts from, by composing the runs' maps pairwise.

    A run acts on the version as a map that differs from identity only at versions its calls
    name. Maps of neighbours are composed in log2(runs) rounds, then the start of every run is
    read off on the way back down.
    """
    numbered = runs.select("object_id", "run").distinct().withColumn(
        "block", F.row_number().over(W.partitionBy("object_id").orderBy("run")).cast("long") - 1
    )
    slim = runs.select("object_id", "run", "seq", "needs").repartition("object_id", "run").sortWithinPartitions(
        "object_id", "run", F.desc("seq")
    )
    maps = slim.mapInPandas(_run_maps, "object_id string, run int, low long, high long")
    blocks = pin(maps.join(numbered, ["object_id", "run"]).drop("run"))
    levels, width = [blocks], numbered.agg(F.max("block")).first()[0] + 1
    while width > 1:
        levels.append(pin(_compose(levels[-1])))
        width = (width + 1) // 2
    starts = runs.select("object_id").distinct().select("object_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("start"))
    for level in reversed(levels[:-1]):
        left = starts.withColumn("block", F.col("block") * 2)
        taken = left.join(
            level.withColumnRenamed("low", "start"), ["object_id", "block", "start"], "left"
        ).select("object_id", (F.col("block") + 1).alias("block"), F.coalesce("high", "start").alias("start"))
        starts = pin(left.unionByName(taken))
    return numbered.join(starts, ["object_id", "block"]).select("object_id", "run", "start")


def commitment_outcomes(calls: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """Each register or update call with the version before it and its outcome.

    A call is accepted when it names the stored version: an absent object for register, the
    expected version for update. The version then goes up by one.
    """
    steps = _steps(calls)
    if largest_group(steps, ["object_id"]) <= limit:
        runs = steps.withColumns({"run": F.lit(0), "start": F.lit(0).cast("long")})
    else:
        cut = into_runs(steps, ["object_id"], ["seq"])
        runs = cut.join(_run_starts(cut), ["object_id", "run"])
    slim = runs.select("object_id", "run", "start", "seq", "needs")
    sorted_ = slim.repartition("object_id", "run").sortWithinPartitions("object_id", "run", "seq")
    befores = sorted_.mapInPandas(_replay, "object_id string, seq long, before long")
    before, needs = F.col("before"), F.col("needs")
    outcome = (
        F.when(needs.isNull(), "InvalidRoot").when(needs == before, "ACCEPTED")
        .when(F.col("call") == "register", "ObjectAlreadyRegistered")
        .when(before == 0, "ObjectNotFound").otherwise("InvalidExpectedVersion")
    )
    return steps.join(befores, ["object_id", "seq"]).select(
        "object_id", "seq", "call", "expected_version", "object_root", "evidence_root",
        before.alias("version_before"), outcome.alias("outcome"),
    )


def commitment_fold(outcomes: DataFrame) -> DataFrame:
    """Stored commitment of each object after all calls."""
    kept = outcomes.filter(F.col("outcome") == "ACCEPTED")
    last = F.max_by(F.struct("object_root", "evidence_root", "version_before", "seq"), F.col("seq")).alias("s")
    return kept.groupBy("object_id").agg(last).select(
        "object_id", "s.object_root", "s.evidence_root", (F.col("s.version_before") + 1).alias("version"),
        F.col("s.seq").alias("updated_seq"),
    )


def event_history(outcomes: DataFrame, object_id: str | None = None) -> DataFrame:
    """Events of accepted calls, of one object or all, in log order within the object."""
    kept = outcomes.filter(F.col("outcome") == "ACCEPTED")
    if object_id is not None:
        kept = kept.filter(F.col("object_id") == object_id)
    name = F.when(F.col("call") == "register", "ObjectRegistered").otherwise("ObjectUpdated")
    return kept.select(
        "object_id", "seq", name.alias("event_name"), (F.col("version_before") + 1).alias("version"), "object_root", "evidence_root"
    )


def registrations(outcomes: DataFrame) -> DataFrame:
    """When each object entered the log."""
    entered = (F.col("outcome") == "ACCEPTED") & (F.col("call") == "register")
    return outcomes.filter(entered).select("object_id", F.col("seq").alias("registered_seq"))


def _of_known_objects(calls: DataFrame, registered: DataFrame | None) -> DataFrame:
    if registered is None:
        return calls
    return calls.join(registered, "object_id").filter(F.col("seq") > F.col("registered_seq")).drop("registered_seq")


def attestation_fold(calls: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Current attestation hash per (object, claim) and whether it is revoked.

    Attesting needs a registered object, sets the hash and clears its revocation, so only a
    revocation of the last hash after the last attestation counts.
    """
    keys = ["object_id", "claim_id"]
    valid = (F.col("call") == "attest") & (F.col("attestation_hash") != ZERO_ROOT)
    attests = _of_known_objects(calls.filter(valid), registered)
    last = attests.groupBy(*keys).agg(F.max(F.struct("seq", "attestation_hash")).alias("last")).select(
        *keys, F.col("last.attestation_hash").alias("attestation_hash"), F.col("last.seq").alias("attested_seq")
    )
    revokes = calls.filter(F.col("call") == "revoke").groupBy(*keys, "attestation_hash").agg(
        F.max("seq").alias("revoked_seq")
    )
    joined = last.join(revokes, [*keys, "attestation_hash"], "left")
    return joined.select(
        *keys, "attestation_hash", "attested_seq",
        F.coalesce(F.col("revoked_seq") > F.col("attested_seq"), F.lit(False)).alias("revoked"),
    )


def representation_log(calls: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Last relationship hash per (object, representation) of registered objects."""
    kept = _of_known_objects(calls.filter(F.col("object_root") != ZERO_ROOT), registered)
    return kept.groupBy("object_id", "representation_id").agg(
        F.max_by("object_root", "seq").alias("relationship_hash"), F.max("seq").alias("seq")
    )


def _covered(rows: DataFrame, spans: DataFrame, keys: list[str], out: str, limit: int) -> DataFrame:
    """Whether `seq` lies in any half-open span of its key.

    Spans and rows are merged in log order; the largest span end so far covers a row exactly
    when it lies beyond it. One sorted pass, no range join.
    """
    marks = spans.select(
        *keys, F.col("low").alias("seq"), F.lit(0).alias("side"), F.col("high").alias("reach")
    ).unionByName(rows.select(*keys, "seq", F.lit(1).alias("side"), F.lit(None).cast("long").alias("reach")))
    done = Ordered(marks, keys, ["seq", "side"], limit).running_max("reach", "reached").done()
    hits = done.filter((F.col("side") == 1) & (F.col("reached") > F.col("seq"))).select(*keys, "seq").distinct()
    return rows.join(hits.withColumn(out, F.lit(True)), [*keys, "seq"], "left").withColumn(
        out, F.coalesce(out, F.lit(False))
    )


def publisher_filter(calls: DataFrame, roles: DataFrame, pauses: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """Calls with flags: the sender held the needed role, and the log was not paused."""
    needed = F.when(F.col("call").isin("attest", "revoke"), "attestor").otherwise("publisher")
    rows = calls.select("seq", "call", "sender", needed.alias("role"), F.lit("log").alias("scope"))
    spans = roles.select("sender", "role", F.col("role_from").alias("low"), F.col("role_to").alias("high"))
    halts = pauses.select(F.lit("log").alias("scope"), F.col("pause_from").alias("low"), F.col("pause_to").alias("high"))
    held = _covered(rows, spans, ["sender", "role"], "authorised", limit)
    return _covered(held, halts, ["scope"], "paused", limit).select(
        "seq", "call", "sender", "role", "authorised", "paused", (F.col("authorised") & ~F.col("paused")).alias("kept")
    )


def authorised_calls(calls: DataFrame, roles: DataFrame, pauses: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """The calls that change the log: sent under the needed role while the log was not paused."""
    kept = publisher_filter(calls, roles, pauses, limit).filter("kept").select("seq")
    return calls.join(kept, "seq", "left_semi")
