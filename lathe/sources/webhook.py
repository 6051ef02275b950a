"""Webhook deliveries as a source: signatures, routes and what a payload must hold."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deliveries that lead somewhere, by event and action.
ROUTES = {("installation", "created"): "installation", ("installation", "deleted"): "installation", ("installation_repositories", "added"): "repositories", ("installation_repositories", "removed"): "repositories", ("pull_request", "opened"): "review", ("pull_request", "synchronize"): "review", ("pull_request", "reopened"): "review", ("push", ""): "index"}


def hmac_sha256(payload: Column, secret: bytes) -> Column:
    """The keyed hash of a payload in hex, from two plain ones over the padded key."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.coalesce(payload.cast("binary"), F.lit(bytearray()))), 256))), 256)


def signed(payload: Column, signature: Column, secret: bytes) -> Column:
    """Whether a delivery's signature header is that of its payload; a missing or malformed one isn't."""
    return F.coalesce(F.lower(signature) == F.concat(F.lit("sha256="), hmac_sha256(payload, secret)), F.lit(False))


def routed(deliveries: DataFrame, secret: bytes) -> DataFrame:
    """deliveries (event, action, payload, signature) with route: where a signed delivery leads, ignored, or rejected without a valid signature."""
    route = F.lit("ignored")
    for (event, action), where in ROUTES.items():
        route = F.when((F.col("event") == event) & (F.coalesce("action", F.lit("")) == action), where).otherwise(route)
    return deliveries.withColumn("route", F.when(signed(F.col("payload"), F.col("signature"), secret), route).otherwise("rejected"))


def repository_of(payload: Column) -> Column:
    """What a payload tells about its repository: id, full name, default branch (main without one), and whether all that must be there is."""
    get = lambda path: F.get_json_object(payload, path)
    id_, name = get("$.repository.id").try_cast("long"), get("$.repository.full_name")
    valid = id_.isNotNull() & F.coalesce(name != "", F.lit(False)) & get("$.installation.id").isNotNull()
    return F.struct(id_.alias("id"), name.alias("full_name"), F.coalesce(get("$.repository.default_branch"), F.lit("main")).alias("branch"), valid.alias("valid"))


#: Actions of a pull request that lead to a review, and what a delivery must tell of it.
ACTIONS = ("opened", "reopened", "synchronize")
REQUIRED = ("$.pull_request.number", "$.pull_request.head.sha", "$.pull_request.base.sha", "$.repository.id", "$.repository.full_name", "$.installation.id")


def review_requests(deliveries: DataFrame, repositories: DataFrame) -> DataFrame:
    """deliveries (payload) about pull requests with outcome and, if accepted, repo_id, pr_number, head_sha and base_sha of the review.

    Outcomes in this order: unsupported action, missing fields (absent, null,
    empty or 0), fork (head and base are of different repositories), unknown
    repository (not in repositories: github_repo_id, repo_id), accepted. No
    delivery is dropped.
    """
    get = lambda path: F.get_json_object("payload", path)
    there = F.lit(True)
    for path in REQUIRED:
        there = there & ~F.coalesce(get(path), F.lit("")).isin("", "0", "false")
    same = get("$.pull_request.head.repo.full_name").eqNullSafe(get("$.pull_request.base.repo.full_name"))
    known = repositories.groupBy(F.col("github_repo_id").cast("long").alias("_id")).agg(F.min("repo_id").alias("_repo"))
    rows = deliveries.withColumn("_asked", get("$.repository.id").try_cast("long")).join(known, F.col("_asked") == F.col("_id"), "left")
    outcome = F.when(~F.coalesce(get("$.action").isin(*ACTIONS), F.lit(False)), "unsupported action").when(~there, "missing fields").when(~same, "fork").when(F.col("_repo").isNull(), "unknown repository").otherwise("accepted")
    rows, good = rows.withColumn("outcome", outcome), F.col("outcome") == "accepted"
    told = {"repo_id": F.col("_repo"), "pr_number": get("$.pull_request.number").try_cast("long"), "head_sha": get("$.pull_request.head.sha"), "base_sha": get("$.pull_request.base.sha")}
    return rows.select(*deliveries.columns, "outcome", *[F.when(good, v).alias(k) for k, v in told.items()])


def unique_deliveries(deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of deliveries (delivery_id, at, ...) without those that the host has sent again within the time. State is dropped behind the watermark."""
    return deliveries.withWatermark("at", late).dropDuplicatesWithinWatermark(["delivery_id"])
