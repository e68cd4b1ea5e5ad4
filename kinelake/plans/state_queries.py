"""Stateful replay queries: batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import align, limits
from kinelake.streaming import machines, replay

from .bindings import TRAJ, read, rounded, sql_unit, trajectory


def controls(spark, sf_dir):
    """Events as controls: errors press failure, purchases commit, clicks pull the trigger, signups run batches."""
    e = read(spark, sf_dir, "events")
    is_type = lambda kind: F.col("event_type") == kind
    return e.select(
        "user_id", "event_id", align.seconds(F.col("ts")).alias("t"), "value",
        (is_type("error") & (F.col("value") > 8)).alias("failure"), is_type("purchase").alias("commit"),
        F.when(is_type("click"), 1.0).otherwise(0.0).alias("trigger"), is_type("signup").alias("pending"), (F.col("value") > 8).alias("failed"),
    )


def fsm_replay(spark, sf_dir):
    """The collection state machine over each user's events."""
    return replay.over_table(controls(spark, sf_dir), machines.Collector, "user_id", ["t", "event_id"])


class ShortPairs(machines.PairRecorder):
    """Events are sparser than control steps: a loser is two rows of the last six."""

    capacity, horizon = 6, 2


def collected_pairs(spark, sf_dir):
    """The pairs that the collection saves: each step of the loser and of the winner."""
    return replay.over_table(controls(spark, sf_dir), ShortPairs, "user_id", ["t", "event_id"])


def ring_buffer(spark, sf_dir):
    return replay.over_table(controls(spark, sf_dir), machines.RingBuffer, "user_id", ["t", "event_id"])


def rate_limit(spark, sf_dir):
    """Commands limited step by step along each episode."""
    t = limits.rate_limited(trajectory(spark, sf_dir), "action", ["episode"], ["frame_index"], ["vec_id"], translation=0.05, rotation_deg=10.0, gripper=0.1, right_min_z=0.0)
    pick = lambda i, n: rounded(F.get("limited", F.lit(i)), 5).alias(n)
    return t.select("vec_id", pick(0, "lx"), pick(3, "lqw"), pick(7, "lgrip"), pick(10, "rz"))


QUERIES = {f.__name__: f for f in (fsm_replay, collected_pairs, ring_buffer, rate_limit)}
#: The collection machine step by step: all users advance by one row in each round of the recursion.
_fsm = lambda capacity, horizon: f"""with recursive e as (
    select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k, coalesce(event_type = 'error' and value > 8, false) as failure,
        event_type = 'purchase' as c, event_type = 'click' as active, event_type = 'signup' as pending from events
    ), f as (
    select distinct user_id, 0::bigint as k, 0::bigint as event_id, 'policy' as phase, []::bigint[] as buffer, []::bigint[] as loser, []::bigint[] as winner,
        false as held, false as pressed, null::bigint as armed_at, '' as outcome, []::bigint[] as shown_loser, []::bigint[] as shown_winner from e
    union all
    select user_id, k, event_id,
        case act when 'arm' then 'armed' when 'roll' then 'rolled_back' when 'none' then 'policy' when 'push' then phase
            when 'take' then case when ends then 'policy' when active then 'takeover' else phase end else 'policy' end,
        case when act = 'push' then (buffer || [event_id])[-{capacity}:] when act = 'discard' or ends then [] else buffer end,
        case when act = 'roll' then rolled when act = 'discard' or ends then [] else loser end,
        case when act = 'discard' or ends then [] else taken end,
        failure, c, case act when 'arm' then event_id when 'push' then armed_at end,
        case act when 'arm' then 'rollback_deferred' when 'roll' then 'rolled_back' when 'none' then 'nothing_to_roll_back' when 'discard' then 'discarded'
            else case when ends then case when len(taken) > 0 and len(loser) > 0 then 'saved' else 'incomplete' end else '' end end,
        case when act = 'roll' then rolled when act = 'discard' then [] else loser end, case when act = 'discard' then [] else taken end
    from (select *, act = 'take' and c and not pressed as ends, case when act = 'take' and phase = 'takeover' then winner || [event_id] else winner end as taken,
            case when len(choice) >= {horizon} then choice[-{horizon}:] else [] end as rolled
        from (select *, case when try_roll then case when len(choice) > 0 then 'roll' else 'none' end when phase in ('armed', 'policy') and not (phase = 'policy' and fails) then 'push'
                when phase = 'policy' then 'arm' when fails then 'discard' else 'take' end as act
            from (select *, (phase = 'armed' and not pending) or (phase = 'policy' and fails and not pending) as try_roll,
                    case when phase = 'armed' then list_filter(buffer, lambda x: x <= armed_at) else buffer end as choice
                from (select e.*, f.phase, f.buffer, f.loser, f.winner, f.pressed, f.armed_at, e.failure and not f.held as fails
                    from f join e on e.user_id is not distinct from f.user_id and e.k = f.k + 1))))
    )"""  # noqa: E731
_MOVE = lambda p, t: f"(case when list_distance({p}, {t}) > 0.05 then [{p}[i] + ({t}[i] - {p}[i]) * (0.05::double / list_distance({p}, {t})) for i in range(1, 4)] else {t} end)"
ORACLE = {
    "fsm_replay": f"{_fsm(72, 64)} select user_id, event_id, phase, outcome, len(shown_loser)::int as n_loser, len(shown_winner)::int as n_winner from f where k > 0",
    "collected_pairs": f"""{_fsm(6, 2)}, s as (select * from f where outcome = 'saved')
        select user_id, event_id as pair_id, 'loser' as role, i::int as position, shown_loser[i + 1] as event_id from s, unnest(range(len(shown_loser))) as u(i)
        union all select user_id, event_id, 'winner', i::int, shown_winner[i + 1] from s, unnest(range(len(shown_winner))) as u(i)""",
    "rate_limit": f"""with recursive {TRAJ}, f as (
        select distinct episode, -1::bigint as frame_index, 0::bigint as vec_id, [0.0, 0.0, 0.0]::double[] as lp, [1.0, 0.0, 0.0, 0.0]::double[] as lq, 0.0::double as lg, [0.0, 0.0, 0.0]::double[] as rp from traj
        union all
        select episode, frame_index, vec_id, {_MOVE('lp', 'a[1:3]')},
            case when turn <= 10 then a[4:7] when c > 0.9995 then {sql_unit('line', False)} else [(sin((1 - t) * th) * q[i] + sin(t * th) * r[i]) / sin(th) for i in range(1, 5)] end,
            least(greatest(lg + least(greatest(a[8] - lg, -0.1::double), 0.1::double), 0.0), 1.0), [move[1], move[2], greatest(move[3], 0.0)]
        from (select *, [q[i] + t * (r[i] - q[i]) for i in range(1, 5)] as line, {_MOVE('rp', 'a[9:11]')} as move
            from (select *, case when turn > 10 then 10.0::double / turn else 1.0 end as t, acos(least(c, 1.0)) as th, case when d < 0 then [-e for e in r0] else r0 end as r
                from (select *, abs(d) as c, degrees(2 * acos(least(abs(d), 1.0))) as turn
                    from (select *, list_dot_product(q, r0) as d from (select t.episode, t.frame_index, t.vec_id, t.action as a, f.lp, f.lg, f.rp, {sql_unit('f.lq', False)} as q, {sql_unit('t.action[4:7]', False)} as r0
                        from f join traj t on t.episode = f.episode and t.frame_index = f.frame_index + 1)))))
        ) select vec_id, round(lp[1], 5) + 0.0 as lx, round(lq[1], 5) + 0.0 as lqw, round(lg, 5) + 0.0 as lgrip, round(rp[3], 5) + 0.0 as rz from f where frame_index >= 0""",
    "ring_buffer": """with n as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k, list(event_id) over (partition by user_id order by ts, event_id rows between 71 preceding and current row) as l from events)
        select user_id, event_id, least(k, 72)::bigint as held, l[1] as oldest from n""",
}
