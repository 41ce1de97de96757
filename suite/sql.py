"""The same inputs and results in SQL, as chains of common table expressions."""

from __future__ import annotations

import re

from orewash.specs import NULL_TOKENS, USERS, DatasetSpec

# --- inputs ---------------------------------------------------------------------------------------------------------

CTES = {
    "users": """
        select cast(c_custkey as varchar) as user_id, c_name as name, c_name || '@example.test' as email,
               cast(null as varchar) as phone, n_name as city, cast(18 + c_custkey % 60 as integer) as age,
               timestamp '2024-01-01' + to_days(cast(c_custkey % 30 as integer)) as updated_at
        from customer join nation on c_nationkey = n_nationkey""",
    "ev_base": """
        select event_id, ts, user_id, event_type, value, n_name
        from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey""",
    "ev": """
        select cast(event_id as varchar) as event_id,
               case when event_id % 97 <> 0 then cast(user_id as varchar) end as user_id,
               case when event_id % 53 <> 0 then ts end as ts,
               case when event_id % 31 <> 0 then n_name end as country,
               value as amount, event_type as message
        from ev_base""",
    "ev_np": "select * from ev where message <> 'purchase'",
    "tx": """
        select cast(o_orderkey as varchar) as tx_id,
               case when o_orderkey % 89 <> 0 then cast(o_custkey as varchar) end as user_id,
               case when o_orderkey % 67 <> 0 then o_totalprice end as amount,
               case o_orderstatus when 'F' then 'delivered' when 'O' then 'pending' when 'P' then 'shipped' end
                   as status,
               case when o_orderkey % 71 <> 0 then o_orderdate end as created_at,
               case when o_orderstatus = 'F' then o_orderdate + to_days(3) end as delivered_at
        from orders""",
    "tx_p": """
        select cast(event_id as varchar) as tx_id,
               case when event_id % 89 <> 0 then cast(user_id as varchar) end as user_id,
               case when event_id % 67 <> 0 then value end as amount,
               case event_id % 3 when 0 then 'delivered' when 1 then 'pending' else 'shipped' end as status,
               case when event_id % 71 <> 0 then ts end as created_at,
               cast(null as timestamp) as delivered_at
        from events where event_type = 'purchase'""",
    "ev_versions": """
        select event_id, ts, user_id, event_type, value, n_name from ev_base
        union all
        select event_id, ts + interval 1 hour, user_id, event_type, value + 1, n_name from ev_base
        where event_id % 5 = 0""",
    "raw_events": """
        select cast(event_id as varchar) as event_id,
               case when event_id % 97 = 0 then null when event_id % 43 = 0 then ' null '
                    else cast(user_id as varchar) end as user_id,
               case when event_id % 53 = 0 then 'N/A' when event_id % 59 = 0 then 'garbage'
                    else case event_id % 11
                        when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
                        when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 3 then strftime(ts, '%Y-%m-%d')
                        else cast(ts as varchar) end
               end as ts,
               cast(user_id % 60 + 18 as varchar) || '.9' as age,
               case when event_id % 31 = 0 then ' null ' else '  ' || n_name || ' ' end as country,
               case when event_id % 19 = 0 then 'n/a' else cast(user_id as varchar) || '@example.test' end as email,
               ' ' || event_type as message,
               cast(null as varchar) as name,
               case when event_id % 13 = 0 then 'NaN' when event_id % 17 = 0 then '' else cast(value as varchar) end
                   as price,
               cast(null as varchar) as temperature,
               case when event_id % 7 = 0 then '1,' || lpad(cast(event_id % 1000 as varchar), 3, '0') || '.50'
                    else cast(value as varchar) end as amount,
               cast(null as varchar) as year, cast(null as varchar) as month, cast(null as varchar) as day,
               case when event_id % 101 = 0 then '{"event_id": ' || cast(event_id as varchar) end as _corrupt_record
        from ev_versions""",
    "raw_users": """
        select case when c_custkey % 97 = 0 then ' NULL ' when c_custkey % 83 = 0 then null
                    else cast(c_custkey as varchar) end as user_id,
               ' ' || c_name as name,
               case when v = 1 and c_custkey % 3 = 0 then null when v = 1 then 'new.' || c_name || '@example.test'
                    else c_name || '@example.test' end as email,
               case when c_custkey % 2 = 0 and v = 0 then '+' || cast(c_custkey as varchar) end as phone,
               case when v = 1 and c_custkey % 4 = 0 then 'N/A' else n_name end as city,
               cast(18 + c_custkey % 60 as varchar) as age,
               case when c_custkey % 11 <> 0 then
                    strftime(timestamp '2024-01-01' + to_days(cast(c_custkey % 30 + v as integer)), '%Y-%m-%d %H:%M:%S')
               end as updated_at,
               cast(null as varchar) as year, cast(null as varchar) as month, cast(null as varchar) as day,
               cast(null as varchar) as _corrupt_record
        from (select *, unnest([0, 1]) as v from customer join nation on c_nationkey = n_nationkey)""",
    "tx_versions": """
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, 0 as v from orders
        union all
        select o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate + to_days(1), 1 from orders
        where o_orderkey % 5 = 0""",
    "raw_transactions": """
        select cast(o_orderkey as varchar) as tx_id,
               case when o_orderkey % 97 = 0 then null when o_orderkey % 89 = 0 then ' None '
                    else cast(o_custkey as varchar) end as user_id,
               case when o_orderkey % 41 = 0 or (v = 1 and o_orderkey % 10 = 0)
                         then '-' || cast(o_totalprice as varchar)
                    when o_orderkey % 7 = 0 then '1,' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || '.50'
                    when o_orderkey % 23 = 0 then '' else cast(o_totalprice as varchar) end as amount,
               case o_orderstatus when 'F' then ' delivered' when 'O' then 'pending ' else 'shipped' end as status,
               case when o_orderkey % 59 = 0 then 'garbage'
                    else case o_orderkey % 11
                        when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ')
                        when 1 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                        when 2 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
                        when 3 then strftime(o_orderdate, '%Y-%m-%d')
                        else cast(o_orderdate as varchar) end
               end as created_at,
               case when o_orderstatus = 'F' then strftime(o_orderdate + to_days(3), '%Y-%m-%d') else '' end
                   as delivered_at,
               cast(null as varchar) as email, cast(null as varchar) as name, cast(null as varchar) as age,
               cast(null as varchar) as year, cast(null as varchar) as month, cast(null as varchar) as day,
               cast(null as varchar) as _corrupt_record
        from tx_versions""",
}


def with_ctes(query: str) -> str:
    """``query`` preceded by the input expressions it uses, directly or through one another."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                visit(body)
                if name not in wanted:
                    wanted.append(name)

    visit(query)
    ctes = ",\n".join(f"{name} as ({CTES[name]})" for name in wanted)
    if not ctes:
        return query
    body = query.lstrip()
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{query}"


# --- steps, generated from the canonical columns --------------------------------------------------------------------

TOKENS = ", ".join("'" + t + "'" for t in NULL_TOKENS)


def cast_text(column: str, kind: str) -> str:
    """Lenient reading of a text column as the SQL type for ``kind``."""
    number = f"try_cast(replace({column}, ',', '') as double)"
    if kind == "timestamp":
        return f"coalesce(try_cast({column} as timestamp), try_strptime({column}, '%Y-%m-%dT%H:%M:%S.%gZ'))"
    if kind == "double":
        return f"case when not isnan({number}) then {number} end"
    if kind == "int":
        return f"case when not isnan({number}) then try_cast(trunc({number}) as integer) end"
    return column


def kinds(spec: DatasetSpec) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in spec.schema.fields}


def typed_columns(spec: DatasetSpec, clean: bool) -> str:
    def column(name: str, kind: str) -> str:
        if kind == "string" and clean:
            return f"case when trim({name}) not in ({TOKENS}) then trim({name}) end as {name}"
        return f"{cast_text(name, kind)} as {name}"

    return ", ".join(column(n, k) for n, k in kinds(spec).items())


def reasons(parts: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {cond} then '{code}' end" for cond, code in parts) + ")"


def early_reasons(spec: DatasetSpec) -> str:
    return reasons(
        [("_corrupt_record is not null", "corrupt"), *((f"{c} is null", f"missing:{c}") for c in spec.required)]
    )


def late_reasons(spec: DatasetSpec) -> str:
    return reasons(
        [(f"{c} is null", f"missing:{c}") for c in spec.trusted]
        + [(f"{c} < 0", f"negative:{c}") for c in spec.non_negative]
    )


def columns(spec: DatasetSpec) -> str:
    return ", ".join(spec.columns)


def latest(source: str, spec: DatasetSpec) -> str:
    rest = [c for c in spec.columns if c not in (spec.key, spec.order_by)]
    order = ", ".join(f"{c} desc nulls last" for c in (spec.order_by, *rest))
    return f"""select * exclude (_rank) from (
        select *, row_number() over (partition by {spec.key} order by {order}) as _rank from {source}
    ) where _rank = 1"""


def cleaned(spec: DatasetSpec) -> str:
    return f"select {typed_columns(spec, True)} from raw_{spec.name}"


def normalized(spec: DatasetSpec) -> str:
    return f"""with flagged as (
        select {typed_columns(spec, False)}, {early_reasons(spec)} as reason from raw_{spec.name}
    ) select {columns(spec)}, nullif(reason, '') as reason from flagged"""


def deduped(spec: DatasetSpec) -> str:
    return f"with cleaned as ({cleaned(spec)}) {latest('cleaned', spec)}"


def quarantined(spec: DatasetSpec) -> str:
    return f"""with cleaned as ({cleaned(spec)}), judged as (
        select *, {late_reasons(spec)} as reason from cleaned
    ) select {columns(spec)}, nullif(reason, '') as reason from judged"""


SNAPSHOT = """select user_id, name, email, phone, city, age, seen as updated_at from (
    select *, row_number() over (
        partition by user_id order by seen desc, name desc nulls last, email desc nulls last, phone desc nulls last,
        city desc nulls last, age desc nulls last) as _rank
    from (select *, coalesce(updated_at, timestamp '1900-01-01') as seen from {source})
) where _rank = 1"""




PARTIAL = f"""select user_id, {", ".join(
    f"(max(struct_pack(a := seen, v := {c})) filter (where {c} is not null)).v as {c}" for c in USERS.snapshot
)}, max(seen) as updated_at
from (select *, coalesce(updated_at, timestamp '1900-01-01') as seen from {{source}}) group by user_id"""


def silver_chain(spec: DatasetSpec) -> str:
    """Expressions up to ``accepted`` (silver) and ``rejected``."""
    key_lost = f"case when {spec.key} is null and not contains(early, 'missing:{spec.key}') then 'missing:{spec.key}' end"
    chain = f"""with flagged as (
        select {typed_columns(spec, True)}, _corrupt_record, {early_reasons(spec)} as early from raw_{spec.name}
    ), staged as (
        select *, concat_ws(',', nullif(early, ''), {key_lost}) as first_reason from flagged
    ), fit as (select {columns(spec)} from staged where first_reason = '')"""
    if spec.snapshot:
        return chain + f""", accepted as (
            select {columns(spec)[: -len(", year, month, day")]}, cast(null as integer) as year,
                   cast(null as integer) as month, cast(null as integer) as day,
                   cast(updated_at as date) as event_date
            from ({SNAPSHOT.format(source="fit")})
        ), rejected as (
            select {columns(spec)}, _corrupt_record, first_reason as reason from staged where first_reason <> ''
        )"""
    return chain + f""", winners as (
        select *, {late_reasons(spec)} as reason from ({latest("fit", spec)})
    ), accepted as (
        select {columns(spec)}, cast({spec.order_by} as date) as event_date from winners where reason = ''
    ), rejected as (
        select {columns(spec)}, _corrupt_record, first_reason as reason from staged where first_reason <> ''
        union all
        select {columns(spec)}, null, reason from winners where reason <> ''
    )"""


def metrics(spec: DatasetSpec, measured: list[str]) -> str:
    """Long-form quality counts over ``silver`` rows."""
    rows = [("total_rows", "count(*)")]
    rows += [(f"null_rate_{c}", f"count(*) - count({c})") for c in measured]
    rows += [(f"dq_not_null_{c}", f"count(*) - count({c})") for c in measured]
    rows += [
        (f"dq_unique_{c}", f"count(*) - count(distinct {c}) - coalesce(max(case when {c} is null then 1 else 0 end), 0)")
        for c in spec.unique
    ]
    rows += [
        (f"dq_timestamp_{c}", f"count(*) - count({c})")
        for c in ("ts", "event_timestamp", "updated_at", "created_at")
        if c in measured
    ]
    return "\nunion all\n".join(
        f"select '{name}' as metric, cast({expr} as bigint) as bad, count(*) as total from measured"
        for name, expr in rows
    )


EXACT = "cast(sum(cast(amount as decimal(18,2))) as double)"

ACTIVITY = f"""with e as (
    select user_id, cast(ts as date) as date, count(*) as n from ev_np group by all
), t as (
    select user_id, cast(created_at as date) as date, count(*) as n, {EXACT} as total,
           {EXACT} / nullif(count(amount), 0) as mean
    from tx_p group by all
)
select coalesce(e.user_id, t.user_id) as user_id, coalesce(e.date, t.date) as date,
       coalesce(e.n, 0) as events_count, coalesce(t.n, 0) as transactions_count,
       coalesce(total, 0) as total_revenue, coalesce(mean, 0) as avg_transaction_amount
from e full join t on e.user_id = t.user_id and e.date = t.date"""

REVENUE = f"""select cast(created_at as date) as date, count(*) as transaction_count, {EXACT} as total_revenue,
       {EXACT} / nullif(count(amount), 0) as avg_amount,
       count(*) filter (where status = 'delivered') as delivered_count
from tx group by 1"""

ACTIVE = """with e as (
    select distinct cast(ts as date) as date, user_id from ev_np
), t as (
    select distinct cast(created_at as date) as date, user_id from tx_p
), ed as (select date, count(user_id) as n from e group by 1),
   td as (select date, count(user_id) as n from t group by 1),
   alld as (select date, count(user_id) as n from (select * from e union select * from t) group by 1)
select alld.date, coalesce(ed.n, 0) as event_active_users, coalesce(td.n, 0) as tx_active_users,
       alld.n as total_active_users
from alld left join ed on alld.date = ed.date left join td on alld.date = td.date"""

LTV = f"""with e as (
    select user_id, count(*) as event_count, min(ts) as first_event, max(ts) as last_event from ev group by 1
), t as (
    select user_id, count(*) as transaction_count, {EXACT} as total_revenue from tx group by 1
)
select coalesce(e.user_id, t.user_id) as user_id, event_count, first_event, last_event, transaction_count,
       total_revenue, coalesce(total_revenue, 0) as ltv
from e full join t on e.user_id = t.user_id"""

FACT_EVENTS = """select event_id, ev.user_id, ts, cast(ts as date) as event_date, country, city as user_city,
       cast(age as varchar) as user_age, email as user_email
from ev left join users on ev.user_id = users.user_id"""

FACT_TRANSACTIONS = """select tx_id, tx.user_id, amount, status, created_at, delivered_at,
       cast(created_at as date) as tx_date, city as user_city, cast(age as varchar) as user_age, email as user_email
from tx left join users on tx.user_id = users.user_id"""

DIM_DATE = """select date, cast(year(date) as integer) as year, cast(month(date) as integer) as month,
       cast(day(date) as integer) as day, strftime(date, '%a') as day_of_week,
       cast(week(date) as integer) as week_of_year, strftime(date, '%B') as month_name
from (select cast(ts as date) as date from ev union select cast(created_at as date) from tx)"""
