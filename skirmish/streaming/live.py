"""Streams: hourly counters, and match segments by server with state. The batch twins are in operators.observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENTS = "server long, started long, ended long, map string, observations long, closed_by string"
#: Of timed_segments(): the open segment, the last whole round with its scores, and the round that is being read.
_TIMED = "map string, started long, ended long, observations long, names array<string>, scores array<long>, at long, place string, round long, new_names array<string>, new_scores array<long>"
_STATE = "map string, started long, ended long, observations long, names array<string>, scores array<long>"


def hourly_counters(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls and failures by endpoint and hour of a stream with ts, event_type and value; an hour is final when the watermark has passed it."""
    hours = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("endpoint"))
    return hours.agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 90).alias("failed")).select("endpoint", F.col("window.start").alias("hour"), "calls", "failed")


def segments(scores: DataFrame, returning: int = 4, dropped: float = 0.6, gone: int = 2) -> DataFrame:
    """Segments of a stream of server, round, map, name, score as they are closed, and why: the first that holds of server_gone
    (more than `gone` rounds without the server), map_change, and score_reset (see observations.match_segments).

    A round of a server must come in one batch. The state of a server holds its open segment and the scores of its last round.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        now = list(state.get) if state.exists else None
        out = []
        for number, r in rows.sort_values("round").groupby("round"):
            place, seen = r["map"].iloc[0], dict(zip(r["name"], r["score"]))
            why = None
            if now:
                before = dict(zip(now[4], now[5]))
                back = [n for n in seen if n in before]
                fell = sum(seen[n] < before[n] for n in back)
                reset = len(back) >= returning and fell >= dropped * len(back)
                why = "server_gone" if number - now[2] > gone else "map_change" if place != now[0] else "score_reset" if reset else None
                if why:
                    out.append((key[0], now[1], now[2], now[0], now[3], why))
            fresh = now is None or why
            now = [place, int(number) if fresh else now[1], int(number), 1 if fresh else now[3] + 1, list(seen), [int(x) for x in seen.values()]]
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return scores.groupBy("server").applyInPandasWithState(step, SEGMENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def timed_segments(scores: DataFrame, late: str = "1 hour", gone_seconds: int = 1800, returning: int = 4, dropped: float = 0.6) -> DataFrame:
    """Segments of a stream of server, round, at, map, name, score as they are closed, and why; also of a server that never returns.

    at: the time of the round, its event time. A round may come in several batches: it is read until a later round of its server comes,
    or the watermark (`late` behind the newest row) has passed it, and then compared with the round before. A segment is closed by the
    first of: server_gone (over `gone_seconds` since the round before), map_change, score_reset. A timer on the watermark closes the
    segment of a server that has been away so long, and drops its state. Rows behind the watermark, and of rounds that are
    closed already, are dropped. Batch twin: observations.timed_segments.
    """

    def close(open_, reason, server):
        return (server, open_[1], open_[2], open_[0], open_[3], reason)

    def whole(now: tuple, server: int, out: list) -> tuple:
        """The state after its round has been read whole."""
        place, started, ended, seen, names, old, last, new_place, number, new_names, new = now
        at = number >> 20
        fresh = dict(zip(new_names, new))
        if seen:
            before = dict(zip(names, old))
            back = [n for n in fresh if n in before]
            fell = sum(fresh[n] < before[n] for n in back)
            reset = len(back) >= returning and fell >= dropped * len(back)
            why = "server_gone" if at - last > gone_seconds else "map_change" if new_place != place else "score_reset" if reset else None
            if why:
                out.append(close(now, why, server))
                seen = 0
        return (place if seen else new_place, started if seen else at, at, seen + 1, new_names, new, at, None, None, None, None)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if now[8] is not None:
                now = whole(now, key[0], out)
            due = now[6] + gone_seconds
            if state.getCurrentWatermarkMs() > due * 1000:
                out.append(close(now, "server_gone", key[0]))
                state.remove()
                now = None
        else:
            rows = pd.concat(list(frames))
            rows["second"] = rows["at"].astype("datetime64[us]").astype("int64") // 1_000_000
            for (second, number), r in rows.groupby(["second", "round"]):
                code = (int(second) << 20) + int(number) % (1 << 20)
                if now and now[8] is not None and code > now[8]:
                    now = whole(now, key[0], out)
                if now and second <= now[6] and now[8] is None:
                    continue  # its round has been closed
                if now and now[8] is not None and code < now[8]:
                    continue
                first = r.sort_values("map")["map"].iloc[0]
                held = dict(zip(now[9], now[10])) if now and now[8] == code else {}
                for n, x in zip(r["name"], r["score"]):
                    held[n] = max(int(x), held.get(n, int(x)))
                place = min(first, now[7]) if now and now[8] == code else first
                base = now[:7] if now else (None, 0, 0, 0, [], [], 0)
                now = (*base, place, code, list(held), list(held.values()))
        if now:
            state.update(now)
            until = (now[8] >> 20) if now[8] is not None else now[6] + gone_seconds
            state.setTimeoutTimestamp(max(until * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    marked = scores.withWatermark("at", late)
    return marked.groupBy("server").applyInPandasWithState(step, SEGMENTS, _TIMED, "append", GroupStateTimeout.EventTimeTimeout)
