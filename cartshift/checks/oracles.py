"""The same questions in SQL, for the engine that checks the Spark results.

Written from the rules, not from the Spark code: joins and window functions are fine
here, the checker runs on small tables.
"""

from __future__ import annotations

from cartshift import fixed_values as fixed

ORACLES: dict[str, str] = {}


def with_tables(*names: str, instead: dict[str, tuple[str, ...]] | None = None) -> str:
    """The WITH clause holding the named stand-in tables and what they need.

    ``instead`` gives other SQL for some of them, followed by the tables that this needs.
    """
    instead = instead or {}
    needed: list[str] = []

    def add(name: str) -> None:
        for other in instead[name][1:] if name in instead else NEEDS.get(name, ()):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    sql = {n: instead[n][0] if n in instead else TABLES[n] for n in needed}
    return "with " + ",\n".join(f"{n} as ({sql[n]})" for n in needed) + "\n"


def _address(spread: str, number: str) -> str:
    return f"""case {spread} % 7
        when 0 then '台北市大安區' || cast({number} as varchar)
        when 1 then '南投縣埔里鎮' || cast({number} as varchar)
        when 2 then '東門市場' || cast({number} as varchar) || '號'
        when 3 then '南投門市'
        when 4 then '市區' || cast({number} as varchar)
        when 5 then '新竹巿東區' || cast({number} as varchar) end"""


def _tail(text: str, mark: str) -> str:
    """Three characters ending at the first mark."""
    return f"right(left({text}, cast(position('{mark}' in {text}) as int)), 3)"


def _order_city(text: str) -> str:
    tail = _tail(text, "市")
    return f"""case when position('縣' in {text}) > 0 then {_tail(text, "縣")}
        when position('市' in {text}) > 0 then
            case when {tail} like '%門市%' then null else {tail} end end"""


def _has(text: str) -> str:
    return f"({text} is not null and {text} <> '')"


LINE_ORDER = """l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate"""

NEEDS = {
    "projected": ("legacy",),
    "cleaned": ("legacy", "projected"),
    "recon": ("legacy", "platform"),
    "plan": ("recon", "balances"),
    "tags": ("legacy", "platform"),
    "sums": ("lines",),
    "folded": ("heads", "lines", "sums"),
    "decided": ("heads",),
}

TABLES = {
    # --- customers
    "legacy": f"""
    select case c_nationkey when 0 then '' when 1 then null else c_name end as name,
        (case when c_nationkey < 12 then 'U' else 'u' end) || cast(c_custkey as varchar)
            || '@Example.com' as email,
        case c_nationkey % 6 when 0 then '' when 1 then null
            when 2 then '09' || left(lpad(cast(c_custkey % 400 as varchar), 8, '0'), 2) || '-'
                || right(lpad(cast(c_custkey % 400 as varchar), 8, '0'), 6)
            when 3 then '02' || lpad(cast(c_custkey as varchar), 7, '0')
            else '09' || lpad(cast(c_custkey % 400 as varchar), 8, '0') end as phone,
        case when c_custkey % 11 = 0 then '' else cast(1950 + c_custkey % 70 as varchar) || '-'
            || cast(1 + c_custkey % 13 as varchar) || '-'
            || cast(1 + c_custkey % 28 as varchar) end as birthday,
        case when c_custkey % 11 <> 0 and c_custkey % 13 < 12 then
            make_date(cast(1950 + c_custkey % 70 as int), cast(1 + c_custkey % 13 as int),
                cast(1 + c_custkey % 28 as int)) end as born,
        case c_nationkey % 4 when 0 then '' when 1 then null
            else 'note ' || c_mktsegment end as note,
        case when c_nationkey <> 3 then cast(floor(c_acctbal / 1000) as int) end as points,
        cast(c_nationkey % 3 as int) as credits,
        {_address("c_nationkey", "c_custkey")} as address,
        case when c_mktsegment = 'MACHINERY' then '一般'
            when c_mktsegment <> 'BUILDING' then c_mktsegment end as tier,
        cast(c_custkey % 3 * 100 as decimal(18,4)) as total_spend
    from customer""",
    "projected": """
    select case when name is null or name = '' then '使用者' else name end as full_name,
        email as email_address,
        case when phone <> '' then '886' end as country_calling_code,
        phone as mobile_number, born as birthday, 'Y' as is_member,
        cast(null as varchar) as tags,
        case when note = '' then null
            else '舊站-會員備註-' || coalesce(note, '') || ',' end as note,
        case when points <> 0 then points end as member_points,
        case when credits <> 0 then credits end as store_credits,
        address as original_address
    from legacy""",
    "cleaned": f"""
    with a as (select * exclude (original_address, birthday),
            case when original_address like '%門市%' then '' else original_address end
                as original_address,
            case when birthday >= date '2011-01-01' then null else birthday end as birthday
        from projected),
    b as (select *,
            case when position('縣' in original_address) > 0 then {_tail("original_address", "縣")}
                when position('市' in original_address) > 0 then {_tail("original_address", "市")}
                end as address_city,
            replace(mobile_number, '-', '') as digits,
            case when {_has("mobile_number")}
                then coalesce(note, '') || '舊站電話-' || mobile_number || '。'
                else note end as long_note
        from a),
    c as (select *, case when length(digits) = 10 and digits like '09%' then digits end as mobile
        from b),
    d as (select *, address_city is not null and mobile is not null as known,
            exists (select 1 from c c2 where c2.mobile = c.mobile
                and c2.email_address < c.email_address) as shared
        from c)
    select email_address, case when not shared then mobile end as mobile_number,
        case when not shared and mobile is not null then country_calling_code end
            as country_calling_code,
        birthday, long_note as note, original_address, address_city,
        case when known then full_name end as address_recipient_name,
        case when known then '886' end as address_country_calling_code_of_recipient_phone_number,
        case when known then mobile end as address_recipient_phone_number,
        case when known then replace(original_address, address_city, '') end as address_1,
        case when known then 'TW' end as address_country
    from d""",
    "platform": """
    select 'P' || cast(user_id as varchar) as customer_id,
        'u' || cast(user_id * 20 as varchar) || '@example.com' as email,
        cast(sum(case when event_type = 'purchase' then 1 else 0 end) % 5 as int) as credits,
        cast(count(*) % 7 as int) as points
    from events group by user_id""",
    "recon": """
    select p.customer_id, l.name as full_name, l.email, p.credits as platform_credits,
        p.points as platform_points, l.credits as legacy_credits, l.points as legacy_points
    from legacy l full join platform p on lower(l.email) = lower(p.email)
    where l.credits <> 0 or l.points <> 0 or p.credits <> 0 or p.points <> 0""",
    "tags": """
    select p.customer_id, l.name as full_name, l.email, l.tier
    from legacy l left join platform p on lower(l.email) = lower(p.email)
    where l.tier <> '一般'""",
    "balances": """
    select customer_id, balance from (
        select 'P' || cast(user_id as varchar) as customer_id,
            case when value > 30 then cast(cast(floor(value) as bigint) % 10 as int) end as balance,
            row_number() over (partition by user_id order by ts desc, event_id desc) as rn
        from events) where rn = 1""",
    "plan": """
    select r.*, b.balance, coalesce(legacy_points, 0) - b.balance as point_diff,
        case when r.customer_id is null then 'no_platform_id'
            when count(*) over (partition by r.customer_id) > 1 then 'duplicate'
            when b.balance is null then 'no_balance'
            when coalesce(legacy_points, 0) = b.balance then 'no_diff' else 'change' end as outcome
    from recon r left join balances b on r.customer_id = b.customer_id""",
    "answers": """
    select 'P' || cast(user_id as varchar) as customer_id, event_id, event_type,
        case event_type when 'error' then 422 when 'click' then 500 else 200 end as http_status,
        cast(cast(floor(value) as bigint) % 10 as int) as point_balance
    from events""",
    # --- orders
    "heads": f"""
    select o_orderkey as order_uid, o_orderstatus as platform,
        cast(o_orderkey as varchar) as transaction_no,
        case o_orderkey % 10 when 0 then null when 1 then ''
            else 'S' || cast(o_orderkey as varchar) end as platform_order_id,
        strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') as created_at,
        case o_orderpriority when '1-URGENT' then '交易終結' when '3-MEDIUM' then '已取消'
            when '4-NOT SPECIFIED' then '新訂單' when '5-LOW' then '待確認'
            else case when o_orderstatus = 'P' then '已出貨' else '出貨中' end end as order_status,
        o_orderpriority as payment_info,
        case o_custkey % 3 when 0 then null when 1 then ''
            else strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') end as paid_at,
        case o_custkey % 4 when 0 then '' when 1 then null
            else strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') end as shipped_at,
        case when o_orderpriority = '5-LOW' then '尚未選擇' else o_orderpriority end
            as delivery_type,
        case o_orderkey % 5 when 0 then '' when 1 then null
            else 'memo ' || cast(o_orderkey as varchar) end as shop_note,
        case when o_custkey % 25 = 0 then '' else 'Name ' || cast(o_custkey as varchar) end
            as recipient_name,
        case o_custkey % 6 when 0 then null when 1 then ''
            else 'tel' || cast(o_custkey as varchar) end as recipient_phone,
        case o_custkey % 5 when 0 then null when 1 then ''
            else '9' || lpad(cast(o_custkey as varchar), 8, '0') end as recipient_phone_no0,
        {_address("o_orderkey", "o_custkey")} as recipient_address,
        lpad(cast(o_custkey % 1000 as varchar), 3, '0') as postcode,
        case o_orderkey % 9 when 0 then 'fakeUser@gmail.com' when 1 then 'fakeUser@gmail.com'
            when 2 then 'fakeUser@gmail.com'
            else 'c' || cast(o_custkey as varchar) || '@example.com' end as customer_email,
        cast(floor(o_totalprice) as bigint) as total_amount,
        o_orderkey % 50 as discount_amount, 60 + 20 * (o_orderkey % 3) as shipping_amount
    from orders""",
    "lines": f"""
    select l_orderkey as order_uid, l_partkey, l_suppkey,
        row_number() over (partition by l_orderkey order by {LINE_ORDER}) as line_seq,
        count(*) over (partition by l_orderkey) as n_lines,
        cast(floor(l_extendedprice / l_quantity + 0.5) as bigint) as price,
        cast(l_quantity as bigint) as units,
        cast(l_extendedprice as decimal(18,2)) as amount
    from lineitem""",
    "sums": """
    select order_uid, sum(amount) as subtotal_amount, max(line_seq) as last_seq,
        cast(floor(sum(amount) + 0.5) as bigint) as subtotal_rounded,
        cast(sum(price) as bigint) as unit_sum, cast(sum(price * units) as bigint) as line_sum
    from lines group by order_uid""",
    "folded": """
    with a as (select h.*, s.subtotal_amount, s.last_seq, s.subtotal_rounded, s.unit_sum,
            s.line_sum, s.subtotal_amount + h.shipping_amount - h.total_amount
                - h.discount_amount as implied
        from heads h join sums s on h.order_uid = s.order_uid),
    b as (select *, case when implied > 0 then implied else 0 end as bonus from a)
    select *, cast(floor(bonus) as bigint) as bonus_whole,
        discount_amount + cast(floor(bonus) as bigint) as deducted,
        total_amount + discount_amount + cast(floor(bonus) as bigint) as subtotal
    from b""",
    "decided": f"""
    with d as (select order_uid, platform_order_id, order_status,
            {_has("platform_order_id")} as has_id,
            {_has("paid_at")} as paid, {_has("shipped_at")} as shipped from heads),
    e as (select *,
        case order_status when '交易終結' then 'completed' when '出貨中' then 'confirmed'
            when '已出貨' then 'confirmed' when '已取消' then 'cancelled'
            when '新訂單' then 'pending' end as order_to,
        case when paid then case when order_status = '已取消' then 'refunded' else 'completed' end
            else case when order_status = '交易終結' then 'completed' else 'pending' end end
            as payment_to,
        case order_status when '已取消' then case when shipped then 'returned' else 'pending' end
            when '交易終結' then 'arrived' when '出貨中' then 'shipping'
            when '已出貨' then 'shipped' when '新訂單' then 'pending' end as delivery_to
        from d)
    select *, case when order_to is null then 'unknown_status'
            when not has_id then 'no_platform_id' else 'ok' end as order_outcome,
        case when not has_id then 'no_platform_id' else 'ok' end as payment_outcome,
        case when not has_id then 'no_platform_id'
            when delivery_to is null then 'unknown_status' else 'ok' end as delivery_outcome
    from e""",
}


def _items(basis: str) -> str:
    return f"""
    f as (select *, subtotal_rounded - {basis} as balance from folded),
    items as (
    select l.order_uid, l.line_seq as position, 'CustomProduct' as item_type,
        price + case when line_seq = last_seq and balance < 0 then balance else 0 end as item_price,
        cast(l_partkey as varchar) || '-' || cast(l_suppkey as varchar) as item_name,
        cast(price as varchar) as price_text, units as quantity,
        price * units + case when line_seq = last_seq and balance < 0 then balance else 0 end
            as total
    from lines l join f on l.order_uid = f.order_uid
    union all
    select order_uid, last_seq + 1, 'CustomProduct', balance, '差額', cast(balance as varchar), 1,
        balance from f where balance > 0
    union all
    select order_uid, last_seq + case when balance > 0 then 2 else 1 end, 'CustomProduct',
        shipping_amount, '運費', cast(shipping_amount as varchar), 1, shipping_amount from f
    union all
    select order_uid, last_seq + case when balance > 0 then 3 else 2 end, 'CustomDiscount',
        deducted, '折扣及紅利點數', null, null, deducted from f
    union all
    select order_uid, last_seq + case when balance > 0 then 4 else 3 end, 'CustomProduct', 0,
        '舊站訂單-' || cast(order_uid as varchar), '0', 1, 0 from f)"""


def _and(tables: str, more: str) -> str:
    return tables.rstrip() + "," + more + "\n"


ITEM_SELECT = """select order_uid, cast(position as bigint) as position, item_type,
    cast(item_price as bigint) as item_price, item_name, price_text,
    cast(quantity as bigint) as quantity, cast(total as bigint) as total from items"""

REMARK = f"""concat_ws('',
    case when {_has("shop_note")} then '店家備註: ' || shop_note || '。' end,
    '建立時間: ' || created_at || '。', '訂單狀態: ' || order_status || '。',
    '付款資訊: ' || payment_info || '。',
    case when {_has("paid_at")} then '付款日期: ' || paid_at || '。' end,
    '出貨類型: ' || delivery_type || '。')"""

ORDER_TABLES = with_tables("folded", "lines")
ORACLES["order_items_long"] = _and(ORDER_TABLES, _items("unit_sum")) + ITEM_SELECT
ORACLES["order_items_long_line_total"] = _and(ORDER_TABLES, _items("line_sum")) + ITEM_SELECT
ORACLES["order_headers"] = with_tables("folded") + f"""
select order_uid, customer_email, cast(subtotal as bigint) as subtotal, total_amount as total,
    cast(bonus as decimal(18,2)) as bonus, bonus_whole, {REMARK} as order_remarks
from folded"""
for _name, _basis in (("order_balance_unit", "unit_sum"), ("order_balance_line", "line_sum")):
    ORACLES[_name] = with_tables("folded") + f"""
select order_uid, subtotal_rounded, unit_sum, line_sum, subtotal_rounded - {_basis} as balance
from folded"""

ADDRESS = f"""
    addressed as (select h.*, case when {_has("recipient_phone")} then recipient_phone
            else '0000000000' end as phone,
        {_order_city("recipient_address")} as city from heads h)"""
ORACLES["address_struct_flat"] = _and(with_tables("heads"), ADDRESS) + """
select order_uid, recipient_name, phone as recipient_phone,
    case when city is not null then recipient_address end as address_1,
    case when city is not null then postcode end as postcode, city,
    case when city is not null then 'TW' end as country_code
from addressed"""



def _canonical(*values: str) -> str:
    return " || ".join(f"coalesce(length({v}::varchar) || ':' || {v}::varchar, '-')" for v in values)


REQUEST_ID = f"sha256({_canonical('entity', 'entity_id', 'method', 'path', 'content')})"


def _outbox(
    rows: str, entity: str, entity_id: str, method: str, path: str, body: str,
    seq: str = "1", phase: str = "cast(null as varchar)", content: str | None = None,
) -> str:
    return f"""
    requests as (select '{entity}' as entity, cast({entity_id} as varchar) as entity_id,
        cast({seq} as int) as seq, '{method}' as method, {path} as path, {body} as body_json,
        {phase} as phase, {content or _canonical(f"cast({seq} as int)", body)} as content
        from {rows})"""


OUTBOX_SELECT = f"""select {REQUEST_ID} as request_id, entity, entity_id, seq, method, path,
    body_json, phase from requests"""

ITEM_JSON = """'{"item_type":"' || item_type || '","item_price":' || cast(item_price as varchar)
    || ',"item_data":{"name":"' || item_name || '"'
    || coalesce(',"price":"' || price_text || '"', '') || '}'
    || coalesce(',"quantity":' || cast(quantity as varchar), '')
    || ',"total":' || cast(total as varchar) || '}'"""


def _create_requests(tables: str, addressed: str) -> str:
    return _and(
        _and(_and(tables, _items("unit_sum")), addressed),
        f"""
    texts as (select order_uid, string_agg({ITEM_JSON}, ',' order by position) as items_text
        from items group by order_uid),
    digests as (select order_uid, md5({_canonical("line_seq", "l_partkey", "l_suppkey", "price", "units")}) as d
        from lines),
    contents as (select order_uid, {", ".join(f"cast(sum(cast('0x' || substr(d, {8 * i + 1}, 8) as bigint)) as bigint) as q{i}" for i in range(4))}
        from digests group by order_uid),
    around as (select f.order_uid, last_seq, f.balance, f.shipping_amount, f.deducted,
        '{{"order":{{"delivery_option_id":"delivery-1",'
        || '"payment_method_id":"payment-1","customer_email":"' || f.customer_email
        || '","subtotal":' || cast(subtotal as varchar) || ',"total":'
        || cast(f.total_amount as varchar) || ',"items":[' as before,
        '],"delivery_address":{{"recipient_name":' || coalesce('"' || f.recipient_name || '"', 'null')
        || ',"recipient_phone":"' || phone || '"'
        || case when a.city is not null then ',"address_1":"' || f.recipient_address
            || '","postcode":"' || f.postcode || '","city":"' || a.city
            || '","country_code":"TW"' else '' end
        || '}},"order_remarks":"' || r.remarks || '"}}}}' as after
        from f join addressed a on f.order_uid = a.order_uid
        join (select order_uid as uid, {REMARK} as remarks from heads) r on f.order_uid = r.uid),
    bodies as (select order_uid, before || items_text || after as body,
        {_canonical("before", "after", "cast(balance as bigint)", "shipping_amount", "shipping_amount",
                    "cast(deducted as bigint)", "last_seq", "q0", "q1", "q2", "q3", "'null'")} as facts
        from around join texts using (order_uid) join contents using (order_uid)),"""
        + _outbox("bodies", "order", "order_uid", "POST", "'/orders'", "body",
                  phase="'first'", content="facts"),
    ) + OUTBOX_SELECT


ORACLES["create_order_json"] = _create_requests(ORDER_TABLES, ADDRESS)
ORACLES["email_fallback"] = with_tables("heads") + "select order_uid, customer_email from heads"

ORACLES["line_numbers"] = f"""
select l_orderkey as order_uid, {LINE_ORDER},
    row_number() over (partition by l_orderkey order by {LINE_ORDER}) as line_seq
from lineitem"""
ORACLES["lines_deduped_window"] = f"""
select order_uid, line_seq, {LINE_ORDER}, created_at from (
    select l_orderkey as order_uid, {LINE_ORDER},
        row_number() over (partition by l_orderkey order by {LINE_ORDER}) as line_seq,
        row_number() over (partition by l_orderkey, l_linenumber order by {LINE_ORDER}) as copy,
        strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') as created_at, o_orderdate
    from lineitem join orders on l_orderkey = o_orderkey)
where copy = 1 or o_orderdate < timestamp '1995-01-01 00:00:00'
    or o_orderdate >= timestamp '1995-07-01 00:00:00'"""
ORACLES["lines_deduped_by_list"] = ORACLES["lines_deduped_window"]
ORACLES["order_lines_of_ids"] = f"""
select l_orderkey as order_uid, {LINE_ORDER} from lineitem
where l_orderkey in (select o_orderkey from orders union all select -1 - o_orderkey from orders)"""
ORACLES["amounts_parsed"] = """
select event_id,
    case event_type when 'click' then 0 when 'error' then null
        else cast(floor(cast(value as decimal(18,2)) + 0.5) as bigint) end as unit_amount,
    cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as units,
    case when event_type not in ('click', 'error') then cast(value as decimal(18,2)) end
        as subtotal_amount,
    cast(null as bigint) as subtotal_rounded,
    case when event_type not in ('click', 'error')
        then cast(floor(cast(value as decimal(18,2))) as bigint) end as discount_amount
from events"""
PRICES = """with p as (select l_orderkey as order_uid, l_linenumber, l_partkey, l_suppkey,
    case when cast(l_extendedprice as decimal(18,2)) = floor(cast(l_extendedprice as decimal(18,2)))
        then cast(cast(floor(l_extendedprice) as bigint) as varchar)
        else cast(cast(l_extendedprice as decimal(18,2)) as varchar) end as price from lineitem),
f as (select *, price like '%.%' as is_fraction, cast(case when price like '%.%'
        then '0.' || split_part(price, '.', 2) else '0' end as decimal(38,18)) as fraction from p)
"""
ORACLES["fraction_amount_first"] = PRICES + """
select order_uid, l_linenumber, l_partkey, l_suppkey, price as unit_price,
    price as items_subtotal, fraction from (
    select *, row_number() over (partition by order_uid order by l_linenumber, l_partkey,
        l_suppkey, price) as rn from f where is_fraction) where rn = 1"""
ORACLES["subtotal_fractions"] = PRICES + r"""
select order_uid, l_linenumber, l_partkey, l_suppkey, items_subtotal, items_subtotal like '%.%' as is_fraction,
    cast(case when items_subtotal like '%.%'
        then '0.' || regexp_extract(split_part(items_subtotal, '.', 2), '^[0-9]*') || '0' else '0' end
        as decimal(38,18)) as fraction
from (select *, price || case l_partkey % 5 when 0 then '99999' when 1 then 'x' when 2 then '.2'
    when 3 then '.' else '' end as items_subtotal from p)"""

UID = "platform || transaction_no"
ORACLES["order_uid_range"] = with_tables("heads") + f"""
select {UID} as order_uid, transaction_no from heads where {UID} >= 'F100' and {UID} < 'F200'"""
ORACLES["order_uid_range_collated"] = """
select * from (select case when o_orderkey % 41 <> 0 then case when o_orderkey % 3 = 0 then lower(o_orderstatus)
        else o_orderstatus end || o_orderkey end as order_uid, o_orderkey from orders)
where lower(order_uid) >= 'f100' and lower(order_uid) < 'f9'"""
ORACLES["order_uids_distinct"] = """
select distinct l_returnflag || cast(l_orderkey as varchar) as order_uid from lineitem"""
ORACLES["orders_purged"] = """
select o_orderkey as order_uid from orders where not exists (select 1 from lineitem
    where l_orderkey = o_orderkey and l_returnflag = 'R' and l_linestatus = 'F')"""
ORACLES["lines_without_recipient_count"] = """
select count(*) as n from lineitem where l_returnflag = 'R' and l_linestatus = 'F'"""

FIXED_ADDRESS = "replace(recipient_address, '巿', '市')"
for _name, _source in (
    ("orders_cleaned", "recipient_address"), ("orders_cleaned_normalized", FIXED_ADDRESS)
):
    ORACLES[_name] = with_tables("heads") + f"""
select {UID} as order_uid, {_order_city(_source)} as recipient_city,
    {FIXED_ADDRESS} as recipient_address, recipient_phone from heads"""
ORACLES["phone_restored"] = with_tables("heads") + f"""
select order_uid, case when created_at like '1995%' then
    case when {_has("recipient_phone_no0")} then '0' || recipient_phone_no0 else '' end
    else recipient_phone end as recipient_phone from heads"""
ORACLES["segment_tail_token"] = f"""
select c_custkey, case when position('T' in c_mktsegment) > 0 then {_tail("c_mktsegment", "T")}
    when position('E' in c_mktsegment) > 0 then
        case when {_tail("c_mktsegment", "E")} like '%CHI%' then null
            else {_tail("c_mktsegment", "E")} end end as city
from customer"""
ORACLES["cities_unknown"] = with_tables("heads", "legacy") + f"""
select distinct city as recipient_city
from (select {_order_city("recipient_address")} as city from heads)
where city is not null
    and city not in (select left(address, 3) from legacy where address is not null)"""
ORACLES["cities_fixed"] = """
select c_custkey, coalesce(r_name, n_name) as n_name
from customer join nation on c_nationkey = n_nationkey
left join region on n_name = 'NATION_' || cast(r_regionkey as varchar)"""

# --- customers
ORACLES["customers_projected"] = with_tables("projected") + "select * from projected"
ORACLES["customers_projected_tier"] = with_tables("legacy") + """
select email as email_address, '舊站-會員級別-' || coalesce(tier, '') || ',' as tags, note,
    case when total_spend <> 0 then total_spend end as total_spend,
    case when points <> 0 then points end as member_points
from legacy"""
ORACLES["customers_cleaned"] = with_tables("cleaned") + "select * from cleaned"
ORACLES["birthday_rejects"] = with_tables("legacy") + """
select email, birthday from legacy where birthday <> '' and born is null"""
ORACLES["customers_too_long"] = """
select doc_id, 'address_1' as "column", cast(length(text) as int) as length
from documents where length(text) > 255
union all
select doc_id, 'full_name', cast(length(source) as int) from documents where length(source) > 100"""
ORACLES["date_cutoff_null"] = """
select o_orderkey, case when cast(o_orderdate as date) < date '1996-01-01'
    then cast(o_orderdate as date) end as birthday from orders"""
ORACLES["phone_like_cleaning"] = with_tables("projected") + f"""
select email_address, mobile as mobile_number,
    case when mobile is not null then country_calling_code end as country_calling_code,
    long_note as note from (
    select *, case when length(replace(mobile_number, '-', '')) = 10
            and replace(mobile_number, '-', '') like '09%'
            then replace(mobile_number, '-', '') end as mobile,
        case when {_has("mobile_number")}
            then coalesce(note, '') || '舊站電話-' || mobile_number || '。' else note end as long_note
    from projected)"""
ORACLES["recipient_block"] = with_tables("projected") + f"""
select email_address, address_city,
    case when known then full_name end as address_recipient_name,
    case when known then mobile_number end as address_recipient_phone_number,
    case when known then replace(address, address_city, '') end as address_1,
    case when known then 'TW' end as address_country from (
    select *, address_city is not null and mobile_number is not null as known from (
        select *, case when position('縣' in address) > 0 then {_tail("address", "縣")}
            when position('市' in address) > 0 then {_tail("address", "市")} end as address_city
        from (select *, replace(original_address, '巿', '市') as address from projected)))"""
ORACLES["dup_phone_report"] = with_tables("legacy") + """
select phone, count(*) as n from legacy group by phone having count(*) > 1"""
ORACLES["dup_key_report"] = """
select p_name, count(*) as n from part group by p_name having count(*) > 1"""
ORACLES["dup_key_keep_min"] = """
select p_partkey, case when not exists (select 1 from part q where q.p_name = p.p_name
    and q.p_partkey < p.p_partkey) then p_name end as p_name from part p"""

# --- products
ORACLES["variant_flag"] = """
select *, count(*) over (partition by p_brand, p_type, p_size) > 1 as has_variant from part"""
ORACLES["variant_projection"] = """
with p as (select *, p_brand || '/' || p_type || '/' || cast(p_size as varchar) as code,
    cast(p_retailprice as decimal(18,4)) as price,
    count(*) over (partition by p_brand, p_type, p_size) > 1 as v from part)
select code as product_handle, p_name as product_name_chinese,
    p_type as product_description_chinese,
    cast(p_partkey as varchar) as product_summary_chinese, true as online_store_status,
    'logo.png' as images, code as sku, case when not v then price end as price,
    case when not v then p_size end as quantity,
    case when v then '規格' end as specification_name_a_chinese,
    case when v then cast(p_partkey as varchar) end as variation_name_a_chinese,
    case when v then price end as variation_price,
    case when v then p_size end as variation_quantity from p"""
ORACLES["products_first_page"] = """
select p_partkey as product_id, p_name from part order by p_partkey limit 5"""

# --- reconciliation
ORACLES["recon_inner"] = with_tables("legacy", "platform") + """
select p.customer_id, l.name as full_name, lower(l.email) as email,
    p.credits as platform_credits, p.points as platform_points, l.credits as legacy_credits,
    l.points as legacy_points
from legacy l join platform p on lower(l.email) = p.email
where l.credits <> 0 or l.points <> 0 or p.credits <> 0 or p.points <> 0"""
ORACLES["recon_left"] = with_tables("legacy", "platform") + """
select p.customer_id, l.name as full_name, l.email, p.credits as platform_credits,
    p.points as platform_points, l.credits as legacy_credits, l.points as legacy_points
from legacy l left join platform p on l.email = p.email
where l.credits <> 0 or l.points <> 0 or p.credits <> 0 or p.points <> 0"""
ORACLES["recon_full"] = with_tables("recon") + "select * from recon"
ORACLES["recon_full_null_rejecting"] = with_tables("tags") + "select * from tags"
ORACLES["balances_latest"] = with_tables("balances") + "select * from balances"
ORACLES["points_plan"] = with_tables("plan") + """
select customer_id, email, legacy_points, balance, point_diff, outcome from plan"""
POINTS_BODY = """'{"value":' || cast(point_diff as varchar)
    || ',"remarks":"舊站點數","email_target":1,"sms_notification_target":1}'"""
ORACLES["points_outbox"] = _and(
    with_tables("plan"),
    _outbox(
        "plan where outcome = 'change'", "customer", "customer_id", "POST",
        "'/customers/' || customer_id || '/member_points'", POINTS_BODY,
    ),
) + OUTBOX_SELECT
ORACLES["points_below_id"] = with_tables("plan") + """
select customer_id, point_diff, outcome from plan where customer_id < 'P5'"""
ORACLES["points_verdict"] = with_tables("recon", "answers") + """
select r.customer_id, event_id, http_status, point_balance, legacy_points,
    case when http_status <> 200 then 'fail' when point_balance = legacy_points then 'success'
        else 'wrong' end as status
from recon r join answers a on r.customer_id = a.customer_id"""
ORACLES["points_audit"] = with_tables("recon", "balances") + """
select r.customer_id, email, legacy_points, balance,
    coalesce(balance = legacy_points, false) as verified
from recon r left join balances b on r.customer_id = b.customer_id"""
DIFFS = """
    diffs as (select customer_id, email,
        coalesce(legacy_credits, 0) - coalesce(platform_credits, 0) as credit_diff,
        coalesce(legacy_points, 0) - coalesce(platform_points, 0) as point_diff from recon)"""
ORACLES["table_differences"] = _and(with_tables("recon"), DIFFS) + "select * from diffs"
ORACLES["credits_outbox"] = _and(
    _and(with_tables("recon"), DIFFS),
    _outbox(
        "diffs where customer_id is not null and credit_diff <> 0", "customer", "customer_id",
        "POST", "'/customers/' || customer_id || '/store_credits'",
        """'{"value":' || cast(credit_diff as varchar) || ',"remarks":"搬站"}'""",
    ),
) + OUTBOX_SELECT
ORACLES["tag_plan"] = with_tables("tags") + """
select customer_id, email, '0325-' || tier as tag,
    case when customer_id is null then 'no_platform_id' else 'ok' end as outcome from tags"""
ORACLES["tag_outbox"] = _and(
    with_tables("tags"),
    _outbox(
        "tags where customer_id is not null", "customer", "customer_id", "PATCH",
        "'/customers/' || customer_id || '/tags'",
        """'{"tags":["0325-' || tier || '"],"update_mode":"add"}'""",
    ),
) + OUTBOX_SELECT
ORACLES["tag_verdict"] = with_tables("answers") + """
select customer_id, event_id, case when event_type in ('error', 'click') then 'fail' else 'success' end
    as status from answers"""
ORACLES["search_resolution"] = """
select o_orderkey as order_uid, count(l_partkey) as n_hits,
    case count(l_partkey) when 0 then 'not_found' when 1 then 'matched' else 'ambiguous' end
        as outcome,
    case when count(l_partkey) = 1 then min(l_partkey) end as platform_order_id
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey"""
ORACLES["found_balances"] = """
select min(l_partkey) as customer_id, cast(min(l_quantity) as int) as balance,
    date '2024-01-01' as fetched_at
from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey having count(*) = 1"""
ORACLES["rows_per_customer"] = """
select c_custkey as user_id, count(o_orderkey) as n_rows,
    case count(o_orderkey) when 0 then 'missing' when 1 then 'ok' else 'duplicate' end as outcome
from customer left join orders on o_custkey = c_custkey group by c_custkey"""

# --- statuses
for _kind in ("order", "payment", "delivery"):
    ORACLES[f"{_kind}_status"] = with_tables("decided") + (
        f"select order_uid, {_kind}_to, {_kind}_outcome from decided"
    )
CHANGES = """
    changes as (
    select order_uid, platform_order_id as id, 1 as n, 'status' as call, order_to as status,
        order_outcome as outcome from decided
    union all
    select order_uid, platform_order_id, 2, 'order_payment_status', payment_to, payment_outcome
        from decided
    union all
    select order_uid, platform_order_id, 3, 'order_delivery_status', delivery_to,
        delivery_outcome from decided)"""
ORACLES["all_status_outbox"] = _and(
    _and(with_tables("decided"), CHANGES),
    _outbox(
        "changes where outcome = 'ok'", "order", "id", "PATCH",
        "'/orders/' || id || '/' || call", """'{"status":"' || status || '"}'""",
        seq="n", phase="'second'",
    ),
) + OUTBOX_SELECT
ORACLES["all_status_rejects"] = _and(with_tables("decided"), CHANGES) + """
select order_uid, cast(n as int) as seq, outcome from changes where outcome <> 'ok'"""
ORACLES["outcome_summary"] = """
select case event_type when 'error' then 'unprocessable' when 'click' then 'error'
    else 'success' end as outcome, count(*) as n from events group by 1"""

# --- ledger
ORACLES["ledger_latest"] = """
select 'customer' as entity, cast(user_id as varchar) as entity_id, event_type as field,
    lpad(cast(event_id as varchar), 12, '0') as value from (
    select *, row_number() over (partition by user_id, event_type
        order by ts desc, event_id desc) as rn from events) where rn = 1"""
ORACLES["ledger_entries"] = with_tables("heads") + """
select 'order' as entity, cast(order_uid as varchar) as entity_id,
    'platform_order_id' as field, platform_order_id as value
from heads where platform_order_id <> ''"""
KEYED = "cast(order_uid as varchar) as order_uid, platform, platform_order_id"
ORACLES["pending_after_ledger"] = with_tables("heads") + f"""
select {KEYED} from heads where order_uid not in (
    select l_orderkey from lineitem where l_returnflag = 'R')"""
ORACLES["orders_not_created"] = with_tables("heads") + f"""
select {KEYED} from heads where platform_order_id is null or platform_order_id = ''"""
ORACLES["platform_ids_written_back"] = with_tables("heads") + """
select cast(order_uid as varchar) as order_uid, platform,
    coalesce(newest, platform_order_id) as platform_order_id
from heads left join (select l_orderkey, 'L' || lpad(cast(l_partkey as varchar), 9, '0') as newest,
    row_number() over (partition by l_orderkey order by l_shipdate desc, l_partkey desc) as rn
    from lineitem where l_returnflag = 'R') w on l_orderkey = order_uid and rn = 1"""
ORACLES["orders_unrecorded"] = with_tables("heads") + """
select distinct cast(order_uid as varchar) as order_uid from heads
where platform_order_id is null and platform = 'P'"""

# --- exports and phases
ORACLES["page_numbers"] = """
select c_custkey, c_name, row_number() over (order by c_name, c_custkey) - 1 as row_index,
    cast(floor((row_number() over (order by c_name, c_custkey) - 1) / 100) as bigint) + 1 as page
from customer"""
ORACLES["page_slice"] = """
select * from customer order by c_name, c_custkey limit 100 offset 200"""
_FILLED = {
    "full_name", "email_address", "country_calling_code", "mobile_number", "birthday",
    "is_member", "note", "member_points", "store_credits",
}
ORACLES["export_headings"] = with_tables("projected") + "select " + ", ".join(
    (column if column in _FILLED
     else f"cast(null as {fixed.TARGET_CUSTOMER_TYPES.get(column, 'varchar')})")
    + f' as "{heading}"'
    for column, heading in fixed.UPLOAD_HEADINGS.items()
) + " from projected"
PHASED = """case o_orderpriority when '1-URGENT' then 'first' when '2-HIGH' then 'second'
    when '3-MEDIUM' then 'third' when '4-NOT SPECIFIED' then 'fourth'
    when '5-LOW' then 'fifth' end as phase"""
ORACLES["phase_union"] = f"""
select phase, count(*) as n, min(o_orderkey) as first_order
from (select o_orderkey, {PHASED} from orders) group by phase"""
ORACLES["phase_union_pruned"] = f"""
select * from (select o_orderkey, o_orderpriority, {PHASED} from orders) where phase = 'third'"""
ORACLES["phase_reloaded"] = ORACLES["phase_union_pruned"]
ORACLES["ledger_compacted"] = ORACLES["ledger_latest"]
ORACLES["jdbc_text_ranges"] = with_tables("legacy") + """
select case when points is not null then nullif(email, '') end as email, name, 1 as ranges from legacy"""
ORACLES["products_csv_read_back"] = """
select *, case when try_cast(stock as int) is null or stock like '%.%' or price = '-' then 'not_a_whole_number' end as reason
from (select 'P' || p_partkey as code,
    case p_partkey % 3 when 0 then '"' || p_name || '",' || chr(10) || p_brand when 1 then p_name || ',x'
        else p_name end as name,
    p_type as style, cast(p_size as varchar) as size,
    case p_size % 9 when 0 then 'n/a' when 1 then p_size || '.5' else cast(p_size as varchar) end as stock,
    case when p_partkey % 11 = 0 then '-' else cast(cast(floor(p_retailprice) as bigint) as varchar) end as price
    from part)"""
ORACLES["search_resolution_as_of"] = """
with e as (select *, left(event_type, 1) || event_id as ident from events),
searches as (select user_id, date_trunc('day', ts) as seen, case when event_type in ('click', 'purchase') then ident end as hit
    from e where event_type <> 'signup'),
newest as (select user_id, seen, count(hit) as n, min(hit) as hit from searches s
    where seen = (select max(seen) from searches o where o.user_id = s.user_id) group by user_id, seen),
recorded as (select user_id, arg_max(ident, (ts, ident)) as known, max(ts) as known_at from e
    where event_type = 'signup' group by user_id),
both_ as (select c_custkey, coalesce(n, 0) as n, hit, seen, known, known_at,
    known_at is not null and coalesce(seen <= known_at, true) as older
    from customer left join newest on newest.user_id = c_custkey left join recorded r on r.user_id = c_custkey)
select c_custkey as order_uid, case when not older then n end as n_hits,
    case when older then 'recorded' when n = 0 then 'not_found' when n = 1 then 'matched' else 'ambiguous' end as outcome,
    case when older then known when n = 1 then hit end as platform_order_id,
    cast(floor(epoch(case when older then known_at else seen end)) as bigint) as as_of
from both_"""
ORACLES["purge_plan"] = _and(
    with_tables("platform"),
    _outbox(
        "platform where customer_id > 'P2'", "customer", "customer_id", "DELETE",
        "'/customers/' || customer_id", "cast(null as varchar)",
    ),
) + OUTBOX_SELECT
ORACLES["customers_above"] = with_tables("platform") + """
select * from platform where customer_id > 'P2'"""
ORACLES["cancel_plan"] = _and(
    with_tables("heads"),
    _outbox(
        "heads where platform_order_id <> ''", "order", "platform_order_id", "PATCH",
        "'/orders/' || platform_order_id || '/cancel'",
        """'{"order_id":"' || platform_order_id
            || '","cancelled_reason":{"key":"other","message":"刪除測試商店訂單"}}'""",
    ),
) + OUTBOX_SELECT

ORACLES["export_first_rows"] = (
    ORACLES["export_headings"] + f" order by email_address limit {fixed.CSV_EXPORT_ROWS}"
)
ORACLES["export_page_rows"] = ORACLES["export_headings"].replace(
    " from projected",
    ", cast(floor((row_number() over (order by email_address) - 1) / 100) as bigint) + 1 as page"
    " from projected",
)

# --- whole flows
EXPORTED_AT = """cast(year(o_orderdate) + 24 as varchar) || strftime(o_orderdate, '/%m/%d %H:%M:%S')"""
TABLES["export_heads"] = f"""
    select * replace (
        case when order_uid % 43 <> 0 then platform || transaction_no end as order_uid,
        case order_uid % 10 when 0 then 'S' || cast(order_uid as varchar) when 1 then '' end
            as platform_order_id,
        {EXPORTED_AT} as created_at,
        case when {EXPORTED_AT} like '2023%' then
            case when {_has("recipient_phone_no0")} then '0' || recipient_phone_no0 else '' end
            else recipient_phone end as recipient_phone,
        {FIXED_ADDRESS} as recipient_address,
        case when order_uid % 41 <> 0 then discount_amount end as discount_amount),
        order_uid as order_key, {_order_city("recipient_address")} as city,
        year(o_orderdate) = 1999 and month(o_orderdate) <= 6 as exported_twice,
        case when order_uid % 37 > 1 then cast(o_totalprice as decimal(18,2)) end
            as subtotal_amount,
        case order_uid % 37 when 0 then null when 1 then 0
            else cast(floor(cast(o_totalprice as decimal(18,2)) + 0.5) as bigint) end
            as subtotal_rounded
    from ({TABLES["heads"]}) h join orders on o_orderkey = h.order_uid"""
TABLES["export_uids"] = """
    select distinct order_uid from export_heads where not (order_uid is not null
        and recipient_name = '' and delivery_type = '尚未選擇'
        and order_key in (select l_orderkey from lineitem))"""
TABLES["export_ledger"] = """
    select o_orderstatus || cast(o_orderkey as varchar) as uid, 'L' || cast(o_custkey as varchar)
        as recorded from orders where o_custkey % 3 = 0"""
TABLES["export_open"] = """
    select u.order_uid, h.order_key, h.exported_twice, h.platform_order_id,
        h.order_key in (select l_orderkey from lineitem) as has_lines
    from export_uids u left join export_heads h on u.order_uid = h.order_uid
    where u.order_uid is null or u.order_uid not in (select uid from export_ledger)"""
TABLES["export_lines"] = f"""
    select *, count(*) filter (price is null) over (partition by order_uid) as bad_lines from (
        select o.order_uid, l_partkey, l_suppkey, l_linenumber, exported_twice,
            row_number() over (partition by l_orderkey order by {LINE_ORDER}) as line_seq,
            row_number() over (partition by l_orderkey, l_linenumber order by {LINE_ORDER}) as copy,
            case when not (l_linenumber = 7 and l_quantity > 40) then
                cast(floor(cast(l_extendedprice as decimal(18,2)) + 0.5) as bigint) end as price,
            cast(l_quantity as bigint) as units
        from lineitem join export_open o on l_orderkey = order_key
        where o.platform_order_id is null or o.platform_order_id = '')
    where copy = 1 or not exported_twice"""
NEEDS |= {
    "export_uids": ("export_heads",),
    "export_open": ("export_uids", "export_heads", "export_ledger"),
    "export_lines": ("export_open",),
}
EXPORTED_ORDERS = {
    "heads": (
        "select * exclude (subtotal_amount, subtotal_rounded) from export_heads", "export_heads",
    ),
    "lines": ("select * from export_lines", "export_lines"),
    "sums": (
        """select l.order_uid, h.subtotal_amount, max(line_seq) as last_seq, h.subtotal_rounded,
            cast(sum(price) as bigint) as unit_sum, cast(sum(price * units) as bigint) as line_sum
        from lines l join export_heads h on l.order_uid = h.order_uid
        where bad_lines = 0 and h.subtotal_rounded is not null and h.discount_amount is not null
        group by all""",
        "lines", "export_heads",
    ),
}
ORACLES["flow_create_orders"] = _create_requests(
    with_tables("folded", "lines", instead=EXPORTED_ORDERS),
    f"""
    addressed as (select *, case when {_has("recipient_phone")} then recipient_phone
        else '0000000000' end as phone from heads)""",
)
ORACLES["flow_create_rejects"] = with_tables("export_lines", "export_heads") + """
select 'order' as entity, order_uid as entity_id, 'no_lines' as reason from export_open
where order_uid is null or not has_lines
union all
select distinct 'order', l.order_uid, 'bad_amount'
from export_lines l join export_heads h on l.order_uid = h.order_uid
where bad_lines > 0 or h.subtotal_rounded is null or h.discount_amount is null"""
for _part in ("orders", "rejects"):
    ORACLES[f"flow_create_stored_{_part}"] = ORACLES[f"flow_create_{_part}"]
SYNCED = {
    "heads": (
        """select * replace (coalesce(recorded, platform_order_id) as platform_order_id)
        from export_heads left join export_ledger on uid = order_uid
        where order_uid in (select order_uid from export_uids)
            and order_key in (select l_orderkey from lineitem)""",
        "export_heads", "export_ledger", "export_uids",
    ),
}
ORACLES["flow_sync_statuses"] = _and(
    _and(with_tables("decided", instead=SYNCED), CHANGES),
    _outbox(
        "changes where outcome = 'ok'", "order", "id", "PATCH",
        "'/orders/' || id || '/' || call", """'{"status":"' || status || '"}'""",
        seq="n", phase="'second'",
    ),
) + OUTBOX_SELECT
ORACLES["flow_sync_rejects"] = _and(with_tables("decided", instead=SYNCED), CHANGES) + """
select 'order' as entity, order_uid as entity_id, outcome as reason from changes
where outcome <> 'ok'
union all
select 'order', u.order_uid, 'no_lines' from export_uids u
where u.order_uid is null or u.order_uid not in (select order_uid from heads)"""
ORACLES["flow_recover_orders"] = with_tables("heads") + """,
    lost as (select order_uid, count(l_partkey) as n, min(l_partkey) as hit
        from heads left join lineitem on l_orderkey = order_uid
        where platform_order_id is null and platform = 'P' and order_uid not in (
            select l_orderkey from lineitem where l_returnflag = 'R')
        group by order_uid)
select case n when 1 then 'settled' else 'reject' end as part,
    cast(order_uid as varchar) as entity_id,
    case n when 0 then 'not_found' when 1 then cast(hit as varchar) else 'ambiguous' end as detail
from lost"""
SHARED_EMAILS = """
    select * replace (case when n % 40 = 1 then 'U' || cast(n - 1 as varchar) || '@Example.com'
        else email end as email)
    from (select *, cast(regexp_extract(email, '[0-9]+') as bigint) as n
        from ({legacy}))""".replace("{legacy}", TABLES["legacy"])


def _open_customers(table: str, event_type: str) -> dict[str, tuple[str, ...]]:
    """Customers without an outcome in the ledger, some of them under a shared e-mail."""
    return {
        "legacy": (SHARED_EMAILS,),
        table: (
            f"""select * from ({TABLES[table]}) t where t.customer_id is null
            or t.customer_id not in (select 'P' || cast(user_id * 3 as varchar) from events
                where event_type = '{event_type}')""",
            *NEEDS[table],
        ),
    }


ORACLES["flow_plan_points"] = (
    with_tables("plan", instead=_open_customers("recon", "purchase"))
    + f"""
select case outcome when 'change' then 'request' when 'no_diff' then 'settled' else 'reject' end
    as part, customer_id as entity_id,
    case outcome when 'change' then {POINTS_BODY} else outcome end as detail from plan"""
)
ORACLES["flow_audit_points"] = (
    with_tables("recon", "balances", instead=_open_customers("recon", "error"))
    + """
select 'customer' as entity, r.customer_id as entity_id, 'points_verified' as field,
    case when coalesce(balance = legacy_points, false) then 'true' else 'false' end as value
from recon r left join balances b on r.customer_id = b.customer_id
where r.customer_id is not null"""
)
ORACLES["flow_plan_tags"] = (
    with_tables("tags", instead=_open_customers("tags", "click"))
    + """
select case when customer_id is null then 'reject' else 'request' end as part,
    coalesce(customer_id, email) as entity_id,
    case when customer_id is null then 'no_platform_id'
        else '{"tags":["0325-' || tier || '"],"update_mode":"add"}' end as detail
from tags"""
)
