"""Leader election and log decisions as row expressions and ordered folds over request tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the protocol's roles and defaults.
ROLES = {0: "follower", 1: "candidate", 2: "leader"}
MIN_ELECTION_TIMEOUT_MS = 150
MAX_ELECTION_TIMEOUT_MS = 300
SNAPSHOT_THRESHOLD = 1000


def role_name(role: Column) -> Column:
    out = F.lit("unknown")
    for code, name in ROLES.items():
        out = F.when(role == code, name).otherwise(out)
    return out


def log_up_to_date(cand_term: Column, cand_index: Column, my_term: Column, my_index: Column) -> Column:
    """The candidate's log is at least as new: term first, then index."""
    return F.struct(cand_term.alias("t"), cand_index.alias("i")) >= F.struct(my_term.alias("t"), my_index.alias("i"))


def quorum(peers: Column | int) -> Column:
    """Votes needed among `peers` others and oneself."""
    peers = F.lit(peers) if isinstance(peers, int) else peers
    return (F.floor((peers + 1) / 2) + 1).cast("bigint")


def prevote_decision(requests: DataFrame) -> DataFrame:
    """Grant iff the leader has been silent long enough, the log is new enough and the term is ahead."""
    ok = ((F.col("silent_ms") >= MIN_ELECTION_TIMEOUT_MS) & (F.col("next_term") > F.col("current_term"))
          & log_up_to_date(F.col("last_log_term"), F.col("last_log_index"), F.col("my_log_term"), F.col("my_log_index")))
    return requests.withColumn("granted", ok)


def vote_fold(requests: DataFrame, start_term: int = 0, log_term: int = 0, log_index: int = 0) -> DataFrame:
    """Each voter answers its requests in order; one vote a term, cleared only by a higher term.

    A request counts while its term is the highest the voter has seen; the term's vote is the first candidate
    among those whose log is new enough. Two running windows, so a voter's history is never one array.
    """
    history = Window.partitionBy("voter").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    in_term = Window.partitionBy("voter", "term").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    new_enough = log_up_to_date(F.col("last_log_term"), F.col("last_log_index"), F.lit(log_term).cast("bigint"), F.lit(log_index).cast("bigint"))
    seen = requests.withColumn("current_term", F.greatest(F.max("term").over(history), F.lit(start_term).cast("bigint")))
    able = seen.withColumn("able", (F.col("term") == F.col("current_term")) & new_enough)
    vote = F.first(F.when(F.col("able"), F.col("candidate")), ignorenulls=True).over(in_term)
    return able.withColumn("vote", vote).select("voter", "ord", "term", "candidate", (F.col("able") & F.col("candidate").eqNullSafe(F.col("vote"))).alias("granted"), "current_term")


def vote_quorum(votes: DataFrame, peers: int) -> DataFrame:
    """Elections won: granted votes of others plus one's own reach the quorum."""
    return (votes.groupBy("term", "candidate").agg(F.count_if("granted").alias("votes"))
            .withColumn("won", F.col("votes") + 1 >= quorum(peers)))


def double_votes(votes: DataFrame) -> DataFrame:
    """Audit: voters that granted two candidates in one term."""
    return (votes.where("granted").groupBy("voter", "term").agg(F.count_distinct("candidate").alias("candidates"))
            .where("candidates > 1"))


def append_fold(appends: DataFrame, start_term: int = 0) -> DataFrame:
    """Followers' answers to leaders' appends: a stale term is refused, any other is accepted."""
    w = Window.partitionBy("node").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.coalesce(F.max("term").over(w), F.lit(start_term)), F.lit(start_term))
    return appends.withColumn("current_term", F.greatest(seen, F.col("term"))).withColumn("success", F.col("term") >= seen)


def applied_state(entries: DataFrame) -> DataFrame:
    """State after applying log entries in index order."""
    won = entries.groupBy("key").agg(F.max_by(F.struct("op", "value"), "idx").alias("e"))
    return won.where("e.op = 'put'").select("key", "e.value")


def snapshot_cut(entries: DataFrame, snap_last_index: int) -> DataFrame:
    """Entries a snapshot leaves in the log, with their place in it."""
    return entries.where(F.col("idx") > snap_last_index).withColumn("slot", F.col("idx") - snap_last_index - 1)


def last_index(entries: DataFrame, snap_last_index: int, snap_last_term: int) -> DataFrame:
    return entries.agg(F.coalesce(F.max("idx"), F.lit(snap_last_index)).alias("last_index"),
                       F.coalesce(F.max_by("term", "idx"), F.lit(snap_last_term)).alias("last_term"))


def catch_up_plan(followers: DataFrame) -> DataFrame:
    """Snapshot or entries: a follower whose next entry the snapshot has swallowed needs the snapshot."""
    need = F.col("has_snapshot") & (F.col("next_index") <= F.col("snap_last_index"))
    return followers.withColumn("send", F.when(need, "snapshot").otherwise("heartbeat"))


def install_snapshot(requests: DataFrame) -> DataFrame:
    """Answers to snapshot requests: a stale term is refused; an accepted snapshot past the log's start moves the start and raises the term."""
    ok = F.col("term") >= F.col("current_term")
    newer = ok & (F.col("snap_last_index") > F.col("log_start"))
    return (requests.withColumn("accepted", ok).withColumn("installed", newer)
            .withColumn("new_term", F.greatest("term", "current_term")).withColumn("new_start", F.when(newer, F.col("snap_last_index")).otherwise(F.col("log_start"))))


def restored(entries: DataFrame, snapshot: DataFrame, snap_last_index: int) -> DataFrame:
    """State after a snapshot has replaced the log up to its index and the entries after it were applied."""
    base = snapshot.select(F.lit(snap_last_index).cast("bigint").alias("idx"), F.lit("put").alias("op"), "key", "value")
    return applied_state(base.unionByName(snapshot_cut(entries, snap_last_index).select("idx", "op", "key", "value")))


def election(prevotes: DataFrame, requests: DataFrame, peers: int, log_term: int = 0, log_index: int = 0) -> DataFrame:
    """Elections by (term, candidate): only a candidate that a quorum would vote for, itself included, asks for votes; a quorum of those elects it.

    prevotes hold a row for each peer asked, with `candidate` and what prevote_decision reads; requests are those that vote_fold reads.
    """
    ahead = (prevote_decision(prevotes).groupBy("candidate", F.col("next_term").alias("term")).agg(F.count_if("granted").alias("prevotes"))
             .where(F.col("prevotes") + 1 >= quorum(peers)))
    asked = requests.join(ahead, ["candidate", "term"], "left_semi")
    won = vote_quorum(vote_fold(asked, 0, log_term, log_index), peers)
    return ahead.join(won, ["candidate", "term"], "left").select("term", "candidate", "prevotes", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("won", F.lit(False)).alias("won"))


def leader_timeline(roles: DataFrame) -> DataFrame:
    """Role changes per node: rows where the role or term differs from the one before."""
    w = Window.partitionBy("node").orderBy("ord")
    changed = ~(F.lag("role").over(w).eqNullSafe(F.col("role")) & F.lag("term").over(w).eqNullSafe(F.col("term")))
    return roles.withColumn("changed", changed).where("changed").drop("changed")


def silent_gaps(heartbeats: DataFrame, timeout_ms: int = MAX_ELECTION_TIMEOUT_MS) -> DataFrame:
    """Gaps between heartbeats long enough to start an election."""
    w = Window.partitionBy("node").orderBy("ms")
    return heartbeats.withColumn("gap_ms", F.col("ms") - F.lag("ms").over(w)).where(F.col("gap_ms") > timeout_ms)
