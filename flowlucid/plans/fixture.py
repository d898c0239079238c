"""The flow table derived from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "cast(regexp_extract(props,'([0-9]+)',1) as bigint)"

# One expression text per column; the same text is valid in Spark and in DuckDB.
FLOW_EXPRESSIONS = {
    "uid": "event_id",
    "ts": "ts",
    "orig_pkts": "cast(floor(value) as bigint)",
    "resp_pkts": f"{K} % 40",
    "orig_bytes": "cast(floor(value) as bigint)*(40+user_id%1400)",
    "resp_bytes": f"case when event_id%11=0 then null else ({K}*event_id)%1500 end",
    "duration": "case when event_id%13=0 then null when event_id%5=0 then cast(0 as double)"
                " else cast((event_id*37)%1000 as double)/100 end",
    "proto": "case user_id%3 when 0 then 'icmp' when 1 then 'tcp' else 'udp' end",
    "service": "case event_id%4 when 0 then 'dns' when 1 then 'http' when 2 then 'ssl' end",
    "conn_state": f"case {K}%5 when 0 then 'OTH' when 1 then 'REJ' when 2 then 'RSTO'"
                  " when 3 then 'S0' else 'SF' end",
    "history": f"case {K}%3 when 0 then 'D' when 1 then 'Dd' else 'ShADadFf' end",
    "label_binary": "case when event_type in ('view','click') then 'False'"
                    " when event_id%97=0 then 'Duplicate' else 'True' end",
    "label_tactic": "case event_type when 'purchase' then 'Discovery' when 'signup' then 'Reconnaissance'"
                    " when 'error' then 'Resource Development' else 'none' end",
    "label_technique": "case when event_type in ('view','click') then 'none'"
                       " when event_id%97=0 then 'Duplicate' when event_type='purchase' then 'T1046'"
                       " when event_type='signup' then case when user_id%2=0 then 'T1590' else 'T1592' end"
                       " else 'T1587' end",
}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{text} AS {name}" for name, text in FLOW_EXPRESSIONS.items()])
