"""The same views as common table expressions for DuckDB."""

_ROLE = "['top', 'jungle', 'mid', 'bot', 'support'][(({0}) - 1) % 5 + 1]"

PARTICIPANTS = f"""did as (select l_orderkey, count(*) filter (l_returnflag = 'R') kills, count(*) filter (l_returnflag = 'A') assists, count(*) filter (l_returnflag = 'N') deaths,
  sum(cast(round(l_extendedprice * 100) as bigint)) gold_earned, sum(cast(l_quantity as bigint)) cs,
  sum(cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)) damage_to_champions,
  sum(case when l_linestatus = 'O' then cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint) else 0 end) damage_to_objectives,
  sum(case when l_linestatus = 'F' then cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint) else 0 end) damage_to_turrets,
  sum(l_linenumber) vision_score, count(*) filter (l_linenumber % 2 = 0) wards_placed, count(*) filter (l_linenumber % 2 = 1) wards_killed,
  sum(cast(round(l_tax * l_extendedprice * 100) as bigint)) damage_mitigated, sum(cast(round(l_discount * 100) as bigint)) healing
  from lineitem group by l_orderkey),
participants as (select o_orderkey // 10 game_id, cast(o_orderkey % 10 + 1 as integer) participant_id, case when o_orderkey % 10 < 5 then 100 else 200 end team_id,
  {_ROLE.format("o_orderkey % 10 + 1")} as role, cast(o_custkey % 25 as integer) champion, o_custkey puuid,
  (o_orderkey // 10) % 2 = case when o_orderkey % 10 < 5 then 0 else 1 end as win,
  {", ".join(f"cast(coalesce({c}, 0) as bigint) {c}" for c in "kills assists deaths gold_earned cs damage_to_champions damage_to_objectives damage_to_turrets vision_score wards_placed wards_killed damage_mitigated healing".split())}
  from orders left join did on l_orderkey = o_orderkey)"""

MATCHES = """matches as (select o_orderkey // 10 game_id, min(o_orderdate) creation, min(cast(substr(o_orderpriority, 1, 1) as integer)) queue,
  cast(300 + (o_orderkey // 10) * 37 % 2700 as integer) duration, cast((o_orderkey // 10) % 10 + 1 as integer) local_id, case when (o_orderkey // 10) % 2 = 0 then 100 else 200 end winner
  from orders group by o_orderkey // 10)"""

EVENTS = """raw_events as (select date_diff('day', date '2024-01-01', cast(ts as date)) game_id, event_id,
  (date_part('hour', ts) * 3600000 + date_part('minute', ts) * 60000 + cast(floor((epoch_us(ts) % 60000000) / 1000) as bigint)) // 40 t_ms,
  case event_type when 'purchase' then 'champion_kill' when 'error' then 'elite_monster_kill' when 'signup' then 'building_kill' when 'click' then 'ward_placed' when 'view' then 'ward_kill' end kind,
  user_id % 10 + 1 killer, cast(json_extract_string(props, '$.k') as bigint) % 10 + 1 victim, (cast(json_extract_string(props, '$.k') as bigint) + user_id) % 10 + 1 a,
  event_id * 7919 % 15000 x, event_id * 104729 % 15000 y, value,
  case when event_type = 'error' then ['HORDE', 'DRAGON', 'RIFTHERALD', 'BARON_NASHOR', 'ATAKHAN'][event_id % 5 + 1] end monster_type,
  case when event_type = 'signup' then ['TOWER_BUILDING', 'TOWER_BUILDING', 'INHIBITOR_BUILDING', 'TOWER_BUILDING'][event_id % 4 + 1] end building_type,
  case when event_type = 'signup' then ['TOP_LANE', 'MID_LANE', 'BOT_LANE'][event_id % 3 + 1] end lane from events),
timeline as (select game_id, event_id, t_ms, kind, killer, victim, case when a <> killer and a <> victim then a end assist, x, y, value, monster_type, building_type, lane from raw_events where killer <> victim and kind is not null)"""

FRAMES = """spine as (select g.game_id, p.participant_id, m.minute from (select distinct game_id from timeline) g, range(1, 11) p(participant_id), range(1, 37) m(minute)),
done as (select game_id, killer participant_id, least(36, t_ms // 60000 + 1) as minute, sum(cast(round(value * 100) as bigint)) g, arg_max(x, event_id + t_ms * 100000000) lx, arg_max(y, event_id + t_ms * 100000000) ly from timeline group by 1, 2, 3),
frames as (select game_id, participant_id, minute * 60000 t_ms, coalesce(sum(g) over w, 0) gold, last_value(lx ignore nulls) over w x, last_value(ly ignore nulls) over w y
  from spine left join done using (game_id, participant_id, minute) window w as (partition by game_id, participant_id order by minute))"""

PAIRS = """labelled as (select source, lang, doc_id, quality, n_chars, lead(doc_id) over w r_id, lead(quality) over w r_q, lead(n_chars) over w r_n from documents join labels using (doc_id) window w as (partition by source order by doc_id)),
pairs as (select source, lang, doc_id left_ref, r_id right_ref, case when quality > r_q then 'left' when quality < r_q then 'right' else 'tie' end choice, n_chars left_score, r_n right_score, n_chars / (n_chars + r_n) p from labelled where r_id is not null)"""
