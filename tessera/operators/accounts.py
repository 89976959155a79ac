"""Accounts and sliding sessions as tables: who may ask, and until when."""

from __future__ import annotations

import hashlib
import hmac
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE_MINUTES, ROUNDS = 60, 210_000


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def username(name: Column) -> Column:
    return F.lower(F.trim(name))


def password_hash(password: str, salt_hex: str) -> str:
    """PBKDF2-HMAC-SHA256 in hex. On purpose slow, so it runs for one login, not over a table."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt_hex), ROUNDS).hex()


def password_fits(password: str, salt_hex: str, expected_hex: str) -> bool:
    return hmac.compare_digest(password_hash(password, salt_hex), expected_hex)


def authorised(claims: DataFrame, users: DataFrame, sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Claims (user_id, session_id) with an active user and a session of theirs that is open and not over at `as_of`."""
    now = F.lit(as_of).cast("timestamp")
    open_ = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).select("user_id", "session_id", "expires_at")
    return claims.join(users.filter("is_active").select("user_id"), "user_id", "left_semi").join(open_, ["user_id", "session_id"])


def renewed(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Slide sessions by a log of requests (session_id, at): each moves the end to 60 minutes after it, if still open.

    A request at or after the end comes too late, and so do all after it. Requests of a session are taken in order.
    """
    log = requests.join(sessions.select("session_id", F.col("expires_at").alias("_end")), "session_id")
    seen = log.groupBy("session_id", "_end").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    step = lambda end, at: F.when(at < end, at + F.expr(f"INTERVAL {IDLE_MINUTES} MINUTES")).otherwise(end)
    moved = seen.select("session_id", F.aggregate("ats", F.col("_end"), step).alias("_new"))
    out = sessions.join(moved, "session_id", "left")
    return out.withColumn("expires_at", F.coalesce("_new", "expires_at")).drop("_new")


def revoked(sessions: DataFrame, user_id: str, keep_session: str, as_of: datetime) -> DataFrame:
    """A login ends the user's other sessions."""
    others = (F.col("user_id") == user_id) & (F.col("session_id") != keep_session) & F.col("revoked_at").isNull()
    return sessions.withColumn("revoked_at", F.when(others, F.lit(as_of).cast("timestamp")).otherwise(F.col("revoked_at")))
