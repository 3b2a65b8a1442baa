"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four rules find the plain cases: these are the seeds. Every seed induces lexical patterns: the shape of the text itself
(digits as 9, runs of letters as a), the word before it, the word after it, and both words together. Candidates are
other runs of up to four words that hold a digit or an @, and they have patterns too. Patterns and texts form a
graph. A pattern is trusted for a kind if most of its distinct texts, and enough of them, are of this kind; a
candidate is accepted if its trusted patterns together make it likely and the text could be of this kind at all. Accepted texts
count for their patterns in the next round. What every accepted text covers is added to the documents, where no rule found
anything: mostly identifiers that stand beside others, so that a rule took both for one and dropped them.

Texts are scanned once, in place; everything after that handles the small table of matches and digit words. Places in a
text are running sums over its matches. Joins go by pattern and by text, both sides shuffled for the join,
so that AQE can split a frequent one; sums are combined before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored

KINDS = ("email", "ip", "card", "phone")

# The rules of the contract. Runs are possessive and begin at their start, which changes no match, as what follows a
# run never belongs to it; so long runs cost linear time and no recursion.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words with a digit or an at sign.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
ADDRESS = rf"^{PART}(?:\.{PART}){{3}}$"
LONG = 64  # characters of a context, a shape or a text from which its digest stands for it


@dataclass(frozen=True)
class Trust:
    """``pattern``: least share of a kind among the texts of a trusted pattern, one doubtful text added;
    ``support``: least number of texts of the kind; ``text``: least likelihood of an accepted text."""

    pattern: float = 0.8
    support: float = 5.0
    text: float = 0.9
    rounds: int = 3
    words: int = 4


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a text of digits holds."""
    place = F.split(F.reverse(number), "")
    values = F.transform(
        place,
        lambda d, i: F.ascii(F.when(i % 2 == 1, F.translate(d, "0123456789", "0246813579")).otherwise(d)) - 48,
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The contract's test of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(ADDRESS)
    number = digits(value)
    if kind == "phone":
        return F.length(number).between(8, 15)
    return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)


def possible(kind: str, value: Column) -> Column:
    """Whether a candidate could be of a kind: wider than the rules, but for addresses."""
    number = digits(value)
    if kind == "email":
        return value.rlike(r"^[^@\x20]++@[^@.\x20]++\.[^@\x20]++$")
    if kind == "ip":
        return value.rlike(ADDRESS)
    if kind == "card":
        return value.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    return value.rlike(r"^\+?[\x20().0-9-]++$") & F.length(number).between(7, 15) & ~value.rlike(ADDRESS)


def short(text: Column) -> Column:
    return F.when(F.length(text) > LONG, F.sha2(text, 256)).otherwise(text)


def context(word: Column) -> Column:
    return short(F.lower(F.regexp_replace(word, "[0-9]", "9")))


def shape(value: Column) -> Column:
    return short(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]+", "a"))


def last_word(piece: Column) -> Column:
    return F.substring_index(F.rtrim(F.translate(piece, SPACES, " " * len(SPACES))), " ", -1)


def first_word(piece: Column) -> Column:
    return F.substring_index(F.ltrim(F.translate(piece, SPACES, " " * len(SPACES))), " ", 1)


def matches(text: Column, kind: int, pattern: str, test) -> Column:
    """An array of the matches of ``pattern``: with the length of the text between it and the match before it
    (``gap``), and the words beside it."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    beside = F.arrays_zip(pieces.alias("before"), found.alias("value"), F.slice(pieces, 2, F.size(pieces)).alias("after"))
    return F.transform(
        F.filter(beside, lambda x: x["value"].isNotNull()),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["before"]).alias("gap"),
            x["value"].alias("value"),
            test(x["value"]).alias("valid"),
            (x["before"] == " ").alias("joined"),
            last_word(x["before"]).alias("before"),
            first_word(F.coalesce(x["after"], F.lit(""))).alias("after"),
        ),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id`` and ``found``: all matches of the rules and all digit words of a text, stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit(None).cast("array<struct<kind:int,gap:int,value:string,valid:boolean,joined:boolean,before:string,after:string>>")
    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = F.col("_plain") != F.col("_bare")
    lists = [
        F.when(has.get(k, digit), matches(text, i, RULES[k], lambda v, k=k: passes(k, v))).otherwise(none)
        for i, k in enumerate(KINDS)
    ]
    lists.append(F.when(digit | has["email"], matches(text, len(KINDS), WORD, lambda v: F.lit(False))).otherwise(none))
    return stored(
        docs.select("doc_id", "text", F.length(text).alias("_plain"), F.length(F.translate(text, "0123456789", "")).alias("_bare"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull())).alias("found"),
        )
    )


def places(rows: DataFrame) -> DataFrame:
    """The matches one by one with ``start`` and ``end`` in their text."""
    one = rows.select("row", F.posexplode("found").alias("pos", "x")).select("row", "pos", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far).cast("int")
    return one.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def candidates(found: DataFrame, words: int) -> DataFrame:
    """Runs of up to ``words`` digit words where no rule holds: ``row``, ``start``, ``end``, ``value``, ``before``, ``after``
    and ``kinds``, whether it could be of each kind. Single words are there in any case: they are evidence too."""
    order = Window.partitionBy("row").orderBy("pos")
    digit_words = found.where(F.col("kind") == len(KINDS))
    ahead = [digit_words["value"], *(F.lead("value", i).over(order) for i in range(1, words + 1))]
    after = [digit_words["after"], *(F.lead("after", i).over(order) for i in range(1, words))]
    joined = [None, *(F.lead("joined", i).over(order) for i in range(1, words))]
    runs = []
    for n in range(1, words + 1):
        run = F.struct(
            F.lit(n).alias("n"),
            F.concat_ws(" ", *ahead[:n]).alias("value"),
            F.when(after[n - 1] != "", after[n - 1]).otherwise(F.coalesce(ahead[n], F.lit(""))).alias("after"),
        )
        linked = reduce(lambda a, b: a & b, [F.coalesce(j, F.lit(False)) for j in joined[1:n]], F.lit(True))
        runs.append(F.when(linked, run))
    before = F.when(F.col("before") != "", F.col("before")).otherwise(F.coalesce(F.lag("value").over(order), F.lit("")))
    one = digit_words.select("row", "start", before.alias("before"), F.array_compact(F.array(*runs)).alias("runs"))
    one = one.select("row", "start", "before", F.explode("runs").alias("x")).select("row", "start", "before", "x.*")
    # punctuation around it, a name and : or = before it
    lead = F.regexp_extract("value", r"^(?:[A-Za-z_-]++[:=])?+[^0-9A-Za-z+(]*+(?:\((?![^)]*\)))?", 0)
    one = one.withColumn("lead", lead).withColumn(
        "value", F.regexp_replace(F.expr("substring(value, length(lead) + 1)"), r"(?<=[0-9A-Za-z])[^0-9A-Za-z]++$", "")
    )
    one = one.where("value != ''").select(
        "row",
        "n",
        (F.col("start") + F.length("lead")).alias("start"),
        (F.col("start") + F.length("lead") + F.length("value")).alias("end"),
        "value",
        F.when(F.col("lead") != "", F.col("lead")).otherwise(F.col("before")).alias("before"),
        "after",
        F.array(*[possible(k, F.col("value")) for k in KINDS]).alias("kinds"),
    )
    one = one.where((F.col("n") == 1) | F.array_contains("kinds", True))
    # what a rule holds already is no candidate: a look at the spans that begin before and after it
    held = found.where("valid").select("row", F.lit(0).alias("n"), "start", "end")
    both = one.unionByName(held, allowMissingColumns=True)
    back = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    is_held = F.col("n") == 0
    both = both.withColumn("_reach", F.max(F.when(is_held, F.col("end"))).over(back)).withColumn(
        "_next", F.min(F.when(is_held, F.col("start"))).over(forth)
    )
    free = (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return both.where(~is_held & free).drop("_reach", "_next", "n")


def edges(rows: DataFrame, *keep: str) -> DataFrame:
    """``pattern`` and ``text`` of each row with its columns ``keep``."""
    before, after = context(F.col("before")), context(F.col("after"))
    patterns = [
        F.concat(F.lit("S "), shape(F.col("value"))),
        F.when(before != "", F.concat(F.lit("L "), before)),
        F.when(after != "", F.concat(F.lit("R "), after)),
        F.when((before != "") & (after != ""), F.concat(F.lit("B "), before, F.lit(" "), after)),
    ]
    return rows.select(short(F.col("value")).alias("text"), F.explode(F.array_compact(F.array(*patterns))).alias("pattern"), *keep)


def learned(spans: DataFrame, other: DataFrame, trust: Trust) -> DataFrame:
    """``text``, ``kind`` and ``score`` of the texts among ``other`` that are accepted."""
    seeds = spans.where("valid").select("value", "kind", "before", "after")
    scores = [F.max((F.col("kind") == i).cast("double")).alias(k) for i, k in enumerate(KINDS)]
    known = stored(seeds.groupBy(short(F.col("value")).alias("text")).agg(*scores))
    could = [F.max(F.get("kinds", F.lit(i)).cast("int")).alias(f"can_{k}") for i, k in enumerate(KINDS)]
    graph = stored(
        edges(seeds.withColumn("kinds", F.lit(None).cast("array<boolean>")), "kinds")
        .unionByName(edges(other, "kinds"))
        .groupBy("pattern", "text")
        .agg(*could)
    )
    zero = [F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in KINDS]
    sums = [F.sum(k).alias(k) for k in KINDS]
    seeded = stored(
        graph.select("pattern", "text").join(known, "text", "left").select("pattern", *zero).groupBy("pattern").agg(F.count("*").alias("n"), *sums)
    )
    open_graph = graph.where(" or ".join(f"can_{k} = 1" for k in KINDS))
    accepted = None
    for _ in range(trust.rounds):
        now = seeded
        if accepted is not None:
            new = accepted.where("not seed").select("text", *[F.when(F.col("kind") == i, F.col("score")).otherwise(0.0).alias(k) for i, k in enumerate(KINDS)])
            gained = stored(graph.select("pattern", "text").join(new, "text").groupBy("pattern").agg(*[F.sum(k).alias(f"more_{k}") for k in KINDS]))
            now = seeded.join(gained, "pattern", "left").select(
                "pattern", "n", *[(F.col(k) + F.coalesce(f"more_{k}", F.lit(0.0))).alias(k) for k in KINDS]
            )
        share = {k: F.col(k) / (F.col("n") + 1) for k in KINDS}
        trusted = {k: F.when((share[k] >= trust.pattern) & (F.col(k) >= trust.support), share[k]) for k in KINDS}
        worth = stored(
            now.select("pattern", *[c.alias(k) for k, c in trusted.items()]).where(" or ".join(f"{k} is not null" for k in KINDS))
        )
        doubt = [(1 - F.exp(F.sum(F.log(1 - F.coalesce(F.col(k), F.lit(0.0)))))).alias(f"is_{k}") for k in KINDS]
        can = [F.max(f"can_{k}").alias(f"can_{k}") for k in KINDS]
        likely = open_graph.join(worth, "pattern").groupBy("text").agg(*doubt, *can)
        likely = open_graph.groupBy("text").agg(*can).join(likely.drop(*[f"can_{k}" for k in KINDS]), "text", "left")
        likely = likely.join(known, "text", "left")
        best = F.greatest(
            *[
                F.when(F.col(f"can_{k}") == 1, F.struct(F.greatest(F.coalesce(k, F.lit(0.0)), F.coalesce(f"is_{k}", F.lit(0.0))).alias("score"), F.lit(-i).alias("order")))
                for i, k in enumerate(KINDS)
            ]
        )
        seed = reduce(lambda a, b: a | b, [F.coalesce(F.col(k), F.lit(0.0)) == 1 for k in KINDS])
        accepted = stored(
            likely.select("text", best.alias("best"), seed.alias("seed"))
            .where(F.col("best.score") >= trust.text)
            .select("text", (-F.col("best.order")).alias("kind"), F.col("best.score").alias("score"), "seed")
        )
    return accepted


def kept_apart(spans: Column) -> Column:
    """Of spans ``(start, -end, kind)`` in order those that begin where the last one kept has ended."""
    empty = F.array().cast("array<struct<start:int,back:int,kind:int>>")
    state = F.struct(F.lit(0).alias("end"), empty.alias("kept"))
    return F.aggregate(
        spans,
        state,
        lambda s, x: F.when(x["start"] >= s["end"], F.struct((-x["back"]).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )


def how_many(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def named(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` of what the rules
    find, ``spans`` with what the method adds, and ``n_added``.

    Places are code points, the end exclusive. Null and empty texts have no spans. Rows are told apart by a number of their
    own, so repeated rows and null ids each get a row; equal texts count once as evidence and all get their
    spans. Of added spans that overlap the leftmost stays, and the longest of those. Ties between kinds go to the first in the order
    listed. Other columns are ignored; an empty table gives an empty result.
    """
    rows = scanned(docs)
    found = stored(places(rows))
    spans = found.where("valid")
    other = stored(candidates(found, trust.words))
    accepted = learned(spans, other, trust)
    added = (
        other.select("row", "start", "end", short(F.col("value")).alias("text"))
        .join(accepted.select("text", "kind"), "text")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind"))).alias("found"))
        .select("row", F.explode(kept_apart(F.col("found"))).alias("x"))
        .select("row", "x.kind", "x.start", (-F.col("x.back")).alias("end"), F.lit(True).alias("added"))
    )
    every = spans.select("row", "kind", "start", "end", F.lit(False).alias("added")).unionByName(added)
    listed = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "added"))).alias("all"))
    joined = rows.select("row", "doc_id").join(listed, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<kind:int,start:int,end:int,added:boolean>>"))
    base = F.filter(every, lambda x: ~x["added"])
    return joined.select(
        "doc_id",
        *[how_many(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(every).alias("spans"),
        (F.size(every) - F.size(base)).cast("long").alias("n_added"),
    )


def op13_private(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def private_sql(trust: Trust = Trust()) -> str:
    """The same in SQL, for tables in which ``doc_id`` is unique."""
    ws = r"\x20\x09-\x0D"
    rules = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        rf"[^{ws}]*[0-9@][^{ws}]*",
    ]
    address = "list_bool_and(list_transform(string_split(value, '.'), lambda p: coalesce(try_cast(p as hugeint) <= 255, false)))"
    luhn = (
        "list_sum(list_transform(list_transform(string_split(reverse(d), ''), lambda x: try_cast(x as int)),"
        " lambda x, i: case when i % 2 = 1 then x when x > 4 then 2 * x - 9 else 2 * x end)) % 10 = 0"
    )
    lines = [
        f"""
docs as (select doc_id, coalesce(text, '') as text from documents),
cut as ({" union all ".join(f"select doc_id, {i} as kind, string_split_regex(text, '{r}') as pieces, regexp_extract_all(text, '{r}') as found from docs" for i, r in enumerate(rules))}),
one as (
  select doc_id, kind, unnest(found) as value, unnest(pieces[:len(found)]) as piece, unnest(pieces[2:]) as next,
         generate_subscripts(found, 1) as pos from cut where len(found) > 0),
placed as materialized (
  select doc_id, kind, pos, value, piece = ' ' as joined, regexp_extract(piece, '([^{ws}]*)[{ws}]*$', 1) as before,
         regexp_extract(next, '^[{ws}]*([^{ws}]*)', 1) as after,
         regexp_replace(value, '[^0-9]', '', 'g') as d,
         (sum(length(piece) + length(value)) over (partition by doc_id, kind order by pos))::bigint as "end"
  from one),
tested as materialized (
  select *, "end" - length(value) as start,
         case kind when 0 then true when 1 then {address} when 2 then length(d) between 16 and 19 and {luhn}
                   when 3 then length(d) between 8 and 15 else false end as valid
  from placed),
spans as (select * from tested where valid),
words as (
  select *, case when before <> '' then before else coalesce(lag(value) over w, '') end as first_before,
         {", ".join(f"lead(value, {i}) over w as v{i}, lead(after, {i}) over w as a{i}, lead(joined, {i}) over w as j{i}" for i in range(1, trust.words + 1))},
         value as v0, after as a0
  from tested where kind = 4 window w as (partition by doc_id order by pos)),
runs as ("""
    ]
    runs = []
    for n in range(1, trust.words + 1):
        text = " || ' ' || ".join(f"v{i}" for i in range(n))
        runs.append(
            f"""
  select doc_id, start, first_before as before, {n} as n, {text} as value,
         case when a{n - 1} <> '' then a{n - 1} else coalesce(v{n}, '') end as after
  from words where {" and ".join(f"j{i}" for i in range(1, n)) or "true"}"""
        )
    plain = {
        "email": "regexp_matches(value, '^[^@ ]+@[^@. ]+\\.[^@ ]+$')",
        "ip": f"regexp_full_match(value, '[0-9]+(\\.[0-9]+){{3}}') and {address}",
        "card": f"regexp_full_match(value, '[0-9]([ -]?[0-9])+') and length(d) between 12 and 19 and {luhn}",
    }
    plain["phone"] = f"regexp_full_match(value, '\\+?[ ().0-9-]+') and length(d) between 7 and 15 and not ({plain['ip']})"
    key = f"case when length(k) > {LONG} then sha256(k) else k end"
    word = lambda c: f"(select {key} from (select lower(regexp_replace({c}, '[0-9]', '9', 'g')) as k))"
    shaped = f"(select {key} from (select regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '[A-Za-z]+', 'a', 'g') as k))"
    lines[0] += " union all ".join(runs) + ")"
    lines.append(
        f"""
led as (
  select *, regexp_extract(value, '^([A-Za-z_-]+[:=])?[^0-9A-Za-z+(]*') as lead0 from runs),
opened as (
  select *, lead0 || case when substr(value, length(lead0) + 1, 1) = '(' and not contains(substr(value, length(lead0) + 1), ')')
                          then '(' else '' end as lead from led),
bare as (
  select * replace (case when regexp_matches(substr(value, length(lead) + 1), '[0-9A-Za-z]')
                         then regexp_replace(substr(value, length(lead) + 1), '[^0-9A-Za-z]+$', '')
                         else substr(value, length(lead) + 1) end as value) from opened),
meant as (
  select doc_id, n, start + length(lead) as start, start + length(lead) + length(value) as "end", value,
         case when lead <> '' then lead else before end as before, after, regexp_replace(value, '[^0-9]', '', 'g') as d
  from bare where value <> ''),
could as (
  select *, {", ".join(f"({c}) as can_{k}" for k, c in plain.items())} from meant),
other as materialized (
  select * from could c where (n = 1 or {" or ".join(f"can_{k}" for k in KINDS)})
  and not exists (select 1 from spans s where s.doc_id = c.doc_id and s.start < c."end" and s."end" > c.start)),
rows as (
  select value, before, after, {", ".join(f"null::boolean as can_{k}" for k in KINDS)} from spans
  union all select value, before, after, {", ".join(f"can_{k}" for k in KINDS)} from other),
worded as (
  select (select {key} from (select value as k)) as text, {shaped} as s, {word("before")} as b, {word("after")} as a,
         {", ".join(f"can_{k}" for k in KINDS)} from rows),
edges as (
  select text, 'S ' || s as pattern, {", ".join(f"can_{k}" for k in KINDS)} from worded
  union all select text, 'L ' || b, {", ".join(f"can_{k}" for k in KINDS)} from worded where b <> ''
  union all select text, 'R ' || a, {", ".join(f"can_{k}" for k in KINDS)} from worded where a <> ''
  union all select text, 'B ' || b || ' ' || a, {", ".join(f"can_{k}" for k in KINDS)} from worded where a <> '' and b <> ''),
graph as materialized (
  select pattern, text, {", ".join(f"coalesce(bool_or(can_{k}), false) as can_{k}" for k in KINDS)} from edges group by pattern, text),
known as materialized (
  select (select {key} from (select value as k)) as text, {", ".join(f"max((kind = {i})::int) as {k}" for i, k in enumerate(KINDS))}
  from spans group by 1),
texts as materialized (
  select text, {", ".join(f"bool_or(can_{k}) as can_{k}" for k in KINDS)} from graph group by text
  having {" or ".join(f"bool_or(can_{k})" for k in KINDS)}),
r0 as (select null::varchar as text, 0 as kind, 0.0::double as score, true as seed where false)"""
    )
    for r in range(1, trust.rounds + 1):
        score = lambda k, i: f"coalesce(k.{k}, case when p.kind = {i} and not p.seed then p.score end, 0)"
        lines.append(
            f"""
p{r} as materialized (
  select pattern, {", ".join(f"case when {k} >= {trust.support} and {k} / (n + 1) >= {trust.pattern} then {k} / (n + 1) else 0 end as {k}" for k in KINDS)}
  from (select pattern, count(*) as n, {", ".join(f"sum({score(k, i)})::double as {k}" for i, k in enumerate(KINDS))}
        from graph g left join known k using (text) left join r{r - 1} p on p.text = g.text group by pattern)),
l{r} as (
  select text, {", ".join(f"1 - exp(sum(ln(1 - {k}))) as {k}" for k in KINDS)}
  from graph join p{r} using (pattern) group by text),
r{r} as materialized (
  select text, -best[2] as kind, best[1] as score, seed from (
    select text, list_max(list_filter([{", ".join(f"case when can_{k} then [greatest(coalesce(k.{k}, 0)::double, coalesce(l.{k}, 0)), {-i}] end" for i, k in enumerate(KINDS))}],
                                      lambda x: x is not null)) as best, k.text is not null as seed
    from texts left join known k using (text) left join l{r} l using (text))
  where best[1] >= {trust.text})"""
        )
    lines.append(
        f"""
hits as (
  select o.doc_id, r.kind::int as kind, o.start, o."end" from other o
  join r{trust.rounds} r on r.text = (select {key} from (select o.value as k))),
every as (
  select doc_id, kind, start, "end", true as base from spans
  union all
  select doc_id, kind, start, "end", false from hits h where not exists (
    select 1 from hits b where b.doc_id = h.doc_id and b.start < h."end" and b."end" > h.start
    and (b.start < h.start or b.start = h.start and b."end" > h."end")))"""
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    shown = f"string_agg({names}[kind + 1] || ':' || start || ':' || \"end\", ',' order by kind, start)"
    return f"""with {",".join(lines)}
select doc_id, {", ".join(f"count(*) filter (base and kind = {i}) as n_{k}" for i, k in enumerate(KINDS))},
       sha256(coalesce({shown} filter (base), '')) as base_sha256, coalesce({shown}, '') as spans,
       count(*) filter (not base) as n_added
from docs left join every using (doc_id) group by doc_id
"""


OP13_SQL = private_sql()
