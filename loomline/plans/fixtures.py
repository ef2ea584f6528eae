"""Turns and threads made of the conversations table.

Its text triggers hardly any filter, so some rows get tags, prefixes, blanks, tools, folders and start times, chosen by
their numbers. The statement runs alike in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TURNS_SQL = """
    select conv_id, turn, cast(turn as int) as pos, turn = first_turn as head, thread_id, source_path, cwd, started_at, model, harness,
      case when role = 'assistant' and turn % 4 = 3 then 'tool_result' when role = 'assistant' and turn % 4 = 1 and conv_id % 5 = 0 then 'tool_call' else role end as kind,
      case when role = 'user' and turn = first_user and conv_id % 33 = 3 then '"[_HIDE_TEST_] ' || text
           when role = 'user' and turn = first_user and conv_id % 33 = 14 then ' [ai-writing-tool] ' || text
           when role = 'user' and turn = first_user and conv_id % 33 = 25 then '[oompa:s1:w2] ' || text
           when role = 'user' and (conv_id + turn) % 7 = 2 then chr(10) || '<system-reminder> ' || text
           when role = 'user' and (conv_id + turn) % 9 = 4 then 'continue'
           when role = 'user' and (conv_id + turn) % 13 = 5 then ' ' || chr(9) || chr(10)
           when role = 'user' and (conv_id + turn) % 11 = 7 then ' ' || text || ' sk-' || 'proj_0123456789abcdefghij' || chr(10)
           when role = 'user' and (conv_id + turn) % 29 = 8 then repeat(text || ' ', 200)
           else text end as text,
      case when role = 'assistant' and turn % 4 = 1 and conv_id % 5 = 0 then 'Bash' end as tool_name,
      case when role = 'assistant' and turn % 4 = 1 and conv_id % 5 = 0 then '{"n": ' || cast(turn as string) || ', "c": "AKIA' || 'ABCDEFGHIJKLMNOP"}' end as tool_input
    from (select conv_id, turn, role, text, min(case when role = 'user' then turn end) over (partition by conv_id) as first_user, min(turn) over (partition by conv_id) as first_turn,
        't' || cast(conv_id as string) as thread_id,
        case when conv_id % 16 = 5 then '/logs/x-private-tmp-claude-y/' else '/logs/p/' end || cast(conv_id as string) || '.jsonl' as source_path,
        case conv_id % 8 when 0 then '/home/user/git/alpha.ww1-i2/src' when 1 then '/home/user/git/beta' when 2 then '/home/user/gamma' when 3 then '/home/user/git/conductor-workspaces/delta.ww3-i4'
             when 4 then case when conv_id % 24 = 4 then '/home/user/git/oompa/run' else '/srv/epsilon' end when 5 then '' when 6 then '/home/user/.config/zeta' else '/mnt/data/home/user/git/eta.ws1f-w2-i3x' end as cwd,
        case when conv_id % 10 = 0 then null when conv_id % 10 = 1 then 'soon' else '2025-' || lpad(cast(1 + conv_id % 12 as string), 2, '0') || '-' || lpad(cast(1 + conv_id % 28 as string), 2, '0') || case when conv_id % 3 = 0 then 'T23:30:00+02:00' when conv_id % 3 = 1 then 'T10:00:00Z' else 'T10:00:00' end end as started_at,
        'm' || cast(conv_id % 3 as string) as model, 'h' || cast(conv_id % 2 as string) as harness
      from conversations) t"""


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with its thread's columns, as the loaders give them."""
    view(spark, sf_dir, "conversations")
    return spark.sql(TURNS_SQL)
