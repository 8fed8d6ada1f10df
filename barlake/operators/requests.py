"""A table of saved filter requests answered in one job.

`requests` has one row per argument: `request_id`, `field`, `text` and optionally `seq`, the
position of the argument in its request (a repeated field keeps its last text). Fields and texts
have the same forms as single filter arguments, suffixes included.

Rows and requests meet by equality, in one scan of the table and one join. A request that lists
values of a text column meets the rows with those values; one that only restricts partition columns
or the day meets the rows of the partitions it fits, found by a join with the partition list, by
equality too; one that does neither is dealt, like the rows, over as many hands as there are shuffle
partitions. All conditions are checked on the pairs that meet; only the forms of conditions that
occur become part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import all_of, any_of
from barlake.functions.filters import LITERAL, SUFFIXES, compile_filters, implied_by_date
from barlake.sources.files import stored_partitions
from barlake.sources.scan import read_stored
from barlake.sources.scratch import kept
from barlake.tables import TEXT_TYPES, TYPES, WHOLE_RANGES, Store, Table

# Wide enough to compare any whole number exactly with text that has a fraction; numbers beyond
# it lie beyond every declared type and are moved to its edge.
_EXACT, _EDGE = "decimal(38,10)", 1e27

# Keyed requests are broadcast up to this many bytes, measured on their rows; beyond it both
# sides are shuffled.
BROADCAST_BYTES = 32 << 20

# Bounds on the day up to this far apart meet partitions month by month.
MOST_MONTHS = 1_200

CONDITION = ("struct<low:string,low_open:boolean,high:string,high_open:boolean,"
             "listed:array<string>,excluded:array<string>,part:string>")


def _quoted(text: str) -> str:
    """The text as a literal of a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entries(table: Table, requests: DataFrame) -> DataFrame:
    """(request_id, field, column, suffix, text, at) of the arguments; column null if there is none."""
    known = {f"{declared}__{sign}": (declared, sign) for declared in table.columns for sign in SUFFIXES}
    known |= {declared: (declared, "eq") for declared in table.columns}  # a declared name wins over a suffix
    # one expression in text: as many columns would take longer to build than the answer takes
    entries = ", ".join(f"{_quoted(name)}, named_struct('column', {_quoted(c)}, 'suffix', {_quoted(sign)})" for name, (c, sign) in known.items())
    found = F.expr(f"try_element_at(map({entries}), field)")
    column, suffix = found["column"], F.coalesce(found["suffix"], F.lit("eq"))
    at = F.col("seq") if "seq" in requests.columns else F.col("text")
    return requests.select("request_id", "field", column.alias("column"), suffix.alias("suffix"), "text",
                           at.alias("at"))


def _items(text: Column) -> Column:
    trimmed = F.transform(F.split(text, ","), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def _condition() -> Column:
    """What one argument asks for, in the forms of `CONDITION`."""
    text, suffix = F.col("text"), F.col("suffix")
    literal = suffix.isin(list(LITERAL))
    range_sign, list_sign = F.instr(text, "~") > 0, F.instr(text, ",") > 0
    is_range = ~literal & (suffix != "ne") & range_sign
    pair = F.when((suffix == "between") & ~range_sign, _items(text))
    low = (F.when(suffix.isin("gt", "gte"), text).when(pair.isNotNull(), F.get(pair, F.lit(0)))
           .when(is_range, F.nullif(F.substring_index(text, "~", 1), F.lit(""))))
    high = (F.when(suffix.isin("lt", "lte"), text).when(pair.isNotNull(), F.get(pair, F.lit(1)))
            .when(is_range, F.nullif(F.expr("substring(text, instr(text, '~') + 1)"), F.lit(""))))
    listed = (F.when(literal | is_range | suffix.isin("ne", "between"), None)
              .when(list_sign | (suffix == "in"), _items(text)).otherwise(F.array(text)))
    excluded = F.when(suffix == "ne", F.when(list_sign & ~range_sign, _items(text)).otherwise(F.array(text)))
    return F.struct(low.alias("low"), (suffix == "gt").alias("low_open"), high.alias("high"),
                    (suffix == "lt").alias("high_open"), listed.alias("listed"), excluded.alias("excluded"),
                    F.when(suffix == "like", text).alias("part")).cast(CONDITION)


def parsed_requests(table: Table, requests: DataFrame) -> DataFrame:
    """One row per request; per declared column an array of conditions, empty if it is not filtered."""
    last = (_entries(table, requests).groupBy("request_id", "field", "column", "suffix")
            .agg(F.max_by("text", "at").alias("text")))
    asked = last.withColumn("asks", F.when(F.col("column").isNotNull() & F.col("text").isNotNull(), _condition()))
    return asked.groupBy("request_id").agg(*[
        F.collect_list(F.when(F.col("column") == c, F.col("asks"))).alias(c) for c in table.columns])


def request_problems(table: Table, requests: DataFrame) -> DataFrame:
    """(request_id, field, problem): unknown fields, empty filters, ends and suffixes that cannot match."""
    numeric = [c for c, t in table.columns.items() if t not in TEXT_TYPES]
    entries = _entries(table, requests).withColumn("asks", _condition())
    asks, number = F.col("asks"), F.col("column").isin(numeric)
    text = F.trim("text")

    def bad(end: Column) -> Column:
        return end.isNotNull() & F.trim(end).try_cast("double").isNull()

    problem = (
        F.when(F.col("column").isNull(), "No column for filter, it is left out")
        .when((F.col("suffix") == "between") & (F.instr(text, "~") == 0) & (F.size(_items(text)) != 2),
              "between needs two values, matches nothing")
        .when(((text == "~") & (F.col("suffix") == "eq")) | (F.size(asks["listed"]) == 0), "Empty filter matches nothing")
        .when(number & (F.col("suffix") == "like"), "like needs a text column, matches nothing")
        .when(number & (bad(asks["low"]) | bad(asks["high"])), "Range end is not a number, matches nothing"))
    return entries.select("request_id", "field", problem.alias("problem")).where("problem IS NOT NULL")


def answer_requests(store: Store, name: str, requests: DataFrame, version: str = "v1"
                    ) -> tuple[DataFrame, DataFrame]:
    """(`request_id` and the rows each request selects, problems of the requests).

    Requests are parsed and written to the shared folder once, because planning looks at them.
    """
    table = store.table(name, version)
    return _answers(store, table, kept(parsed_requests(table, requests))), request_problems(table, requests)


def count_requests(store: Store, name: str, requests: DataFrame, version: str = "v1") -> DataFrame:
    """(request_id, rows): the number of rows each request selects, zero included.

    Requests that restrict partition columns alone are added up from the rows per partition.
    """
    table = store.table(name, version)
    parsed = kept(parsed_requests(table, requests))
    if table.partitions:
        inside = [c for c in table.columns if c not in table.partitions]
        whole = all_of([F.size(c) == 0 for c in inside]) if inside else F.lit(True)
        forms = _forms(table, parsed)
        sizes = read_stored(store, table).groupBy(*table.partitions).agg(F.count("*").alias("n"))
        places = _with_places(table, _satisfiable(table, parsed, forms).where(whole), sizes, forms)
        counted = places.groupBy("request_id").agg(F.sum("n").alias("rows"))
        if any(forms[c] for c in inside):
            rest = _answers(store, table, parsed.where(~whole), forms)
            counted = counted.unionByName(rest.groupBy("request_id").agg(F.count("*").alias("rows")))
    else:
        counted = _answers(store, table, parsed).groupBy("request_id").agg(F.count("*").alias("rows"))
    return (parsed.select("request_id").join(counted, "request_id", "left")
            .select("request_id", F.coalesce("rows", F.lit(0)).alias("rows")))


FORMS = ("low", "high", "listed", "excluded", "part")
Forms = dict[str, frozenset[str]]


def _forms(table: Table, parsed: DataFrame) -> Forms:
    """Per column the forms of conditions that occur, "empty" for conditions that ask for nothing."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("asks")) for c in table.columns]))
    asks = parsed.select(each.alias("one")).select("one.column", F.explode("one.asks").alias("ask"))
    occurs = {f: F.col(f"ask.{f}").isNotNull() for f in FORMS}
    occurs |= {f"{end}_open": F.coalesce(F.col(f"ask.{end}").isNotNull() & F.col(f"ask.{end}_open"), F.lit(False)) for end in ("low", "high")}
    occurs["empty"] = ~any_of([F.col(f"ask.{f}").isNotNull() for f in FORMS]) | (F.coalesce(F.size("ask.listed"), F.lit(1)) == 0)
    found = asks.groupBy("column").agg(*[F.bool_or(o).alias(f) for f, o in occurs.items()]).collect()  # a row per column
    forms = {r["column"]: frozenset(f for f in occurs if r[f]) for r in found}
    return {c: forms.get(c, frozenset()) for c in table.columns}


def _satisfiable(table: Table, parsed: DataFrame, forms: Forms) -> DataFrame:
    """Requests without an empty condition, which matches nothing."""
    empty = [F.exists(c, lambda a: ~any_of([a[f].isNotNull() for f in FORMS]) | (F.coalesce(F.size(a["listed"]), F.lit(1)) == 0))
             for c in table.columns if "empty" in forms[c]]
    return parsed.where(~any_of(empty)) if empty else parsed


def _listing_columns(table: Table) -> list[str]:
    """Text columns inside the files a request may list values of; code columns first."""
    texts = [c for c, t in table.columns.items() if t in TEXT_TYPES and c not in table.partitions]
    return sorted(texts, key=lambda c: "code" not in c.lower())


def _lists(column: str) -> Column:
    return F.exists(column, lambda a: a["listed"].isNotNull())


def _listed_keys(column: str) -> Column:
    """Keys of the values in the first list on the column."""
    return F.transform(F.filter(F.col(column)["listed"], lambda v: v.isNotNull())[0], lambda v: F.xxhash64(F.lit(column), v))


def _answers(store: Store, table: Table, parsed: DataFrame, forms: Forms | None = None) -> DataFrame:
    forms = _forms(table, parsed) if forms is None else forms
    listing = [c for c in _listing_columns(table) if "listed" in forms[c]]
    dated = ["date"] if table.derived or table.calendar else []
    placed = [c for c in dict.fromkeys([*(p for p in table.partitions if p in table.columns), *dated]) if forms[c]]
    hands = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.when(any_of([F.size(c) > 0 for c in placed]), "").otherwise("*") if placed and table.partitions else F.lit("*")
    found = F.transform(F.sequence(F.lit(0), F.lit(hands - 1)), lambda h: F.xxhash64(F.lit("*"), h))
    for c in reversed(listing):
        by, found = F.when(_lists(c), c).otherwise(by), F.when(_lists(c), _listed_keys(c)).otherwise(found)
    used = [c for c in table.columns if forms[c]]
    asked = _satisfiable(table, parsed, forms).withColumns({"by": by, "keys": found})
    asked = asked.select("request_id", "by", "keys", *used)

    ends = _ends(table, forms)
    facts = [F.sum(_bytes(used) * F.size("keys")).alias("bytes"), *[F.min(v).alias(f"least {k}") for k, v in ends.items()],
             *[F.max(v).alias(f"most {k}") for k, v in ends.items()], *[F.count_if(v.isNull()).alias(f"no {k}") for k, v in ends.items()]]
    kinds = {r["by"]: r for r in asked.groupBy("by").agg(*facts).collect()}  # a row for each way to meet
    total = sum(r["bytes"] or 0 for by, r in kinds.items() if by)
    keyed = asked.where("by != ''")
    keyed = keyed.select("request_id", F.explode("keys").alias("key"), *used)
    if "" in kinds:
        places = _with_places(table, asked.where("by = ''"), stored_partitions(store, table), forms)
        places = places.select("request_id", F.xxhash64(F.lit(""), *[f"place.{p}" for p in table.partitions]).alias("key"), *used)
        total += places.agg(F.sum(_bytes(used))).first()[0] or 0
        keyed = keyed.unionByName(places) if len(kinds) > 1 else places
    days = {k: (min if k == "start" else max)(r[f"{'least' if k == 'start' else 'most'} {k}"] for r in kinds.values())
            for k in ends if kinds and not any(r[f"no {k}"] for r in kinds.values())}
    return _meet(store, table, keyed, total, [*kinds], [c for c in listing if c in kinds], used, forms, days, hands)


def _bytes(used: list[str]) -> Column:
    return F.octet_length(F.to_json(F.struct("request_id", *used))) + 8


def _with_places(table: Table, asked: DataFrame, found: DataFrame, forms: Forms) -> DataFrame:
    """The requests with each partition of `found` that fits them, as struct `place`.

    They meet by equality: of a value that a request lists, else of a month within its bounds on the
    day, else requests go to each hand that partitions are dealt to.
    """
    own = [p for p in table.partitions if p in table.columns]
    place = F.col("place")
    fits = [_meets(place[p], F.col(p), table.columns[p], forms[p]) for p in own if forms[p]] + _month_agrees(table, place, forms)
    hands = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.select(F.struct(*table.partitions).alias("place"), *[c for c in found.columns if c not in table.partitions])
    keys = [F.xxhash64(F.lit("*"), F.pmod(F.xxhash64("place"), F.lit(hands)).cast("int"))]
    meet = F.transform(F.sequence(F.lit(0), F.lit(hands - 1)), lambda h: F.xxhash64(F.lit("*"), h))
    month, bounds = _month(table, place), forms.get("date", frozenset())
    if month is not None and {"low", "high"} <= bounds:
        low, high = (F.try_to_date(F.concat(F.substring(end, 1, 7), F.lit("-01")), "yyyy-MM-dd")
                     for end in (F.array_max(F.col("date")["low"]), F.array_min(F.col("date")["high"])))
        several = F.sequence(low, high, F.expr("interval 1 month"))
        months = F.transform(several, lambda d: F.xxhash64(F.lit("month"), F.date_format(d, "yyyy-MM")))
        sound = low.isNotNull() & high.isNotNull() & (low <= high) & (F.months_between(high, low) <= MOST_MONTHS)
        meet = F.when(F.coalesce(sound, F.lit(False)), months).otherwise(meet)
        keys.append(F.xxhash64(F.lit("month"), month))
    for p in own:
        if "listed" in forms[p] and table.columns[p] in TEXT_TYPES:
            meet = F.when(_lists(p), _listed_keys(p)).otherwise(meet)
            keys.append(F.xxhash64(F.lit(p), place[p]))
    met = asked.withColumn("meet", F.explode(meet)).join(found.withColumn("meet", F.explode(F.array(*keys))), "meet").drop("meet")
    return met.where(all_of(fits)) if fits else met


def _month(table: Table, place: Column) -> Column | None:
    """`yyyy-MM` of a partition, if its days lie in one month."""
    if table.derived and set(table.derived) == {"year", "month"}:
        return F.concat(place["year"], F.lit("-"), place["month"])
    if table.calendar and {"Year", "Month"} <= set(table.partitions):
        return F.concat(place["Year"], F.lit("-"), place["Month"])
    return None


def _month_agrees(table: Table, place: Column, forms: Forms) -> list[Column]:
    """Year and month of a partition can hold the days a request asks for."""
    month, used = _month(table, place), forms.get("date", frozenset())
    if month is None or not used & {"low", "high", "listed"}:
        return []

    def agrees(day: Column) -> Column:
        tests = [day["low"].isNull() | (month >= F.substring(day["low"], 1, 7))] if "low" in used else []
        tests += [day["high"].isNull() | (month <= F.substring(day["high"], 1, 7))] if "high" in used else []
        tests += [day["listed"].isNull() | F.exists(day["listed"], lambda v: F.substring(v, 1, 7) == month)] if "listed" in used else []
        return F.coalesce(all_of(tests), F.lit(False))

    return [F.forall("date", agrees)]


def _ends(table: Table, forms: Forms) -> dict[str, Column]:
    """First and last day that a request lets through; null if it does not say so."""
    if table.columns.get("date") not in TEXT_TYPES or not forms["date"]:
        return {}
    return {"start": F.array_max(F.transform("date", lambda a: F.coalesce(a["low"], F.array_min(a["listed"])))),
            "end": F.array_min(F.transform("date", lambda a: F.coalesce(a["high"], F.array_max(a["listed"]))))}


def _meet(store: Store, table: Table, asked: DataFrame, size: int, kinds: list[str], listing: list[str], used: list[str],
          forms: Forms, days: dict[str, str], hands: int) -> DataFrame:
    rows = read_stored(store, table)
    if days:  # all requests together bound the scan
        rows = rows.where(all_of(compile_filters(table.columns, {"date": days})[0]
                                 + implied_by_date(table, {"date": days})))
    keys = [F.xxhash64(F.lit(c), F.col(c)) for c in listing]
    if "" in kinds:
        keys.append(F.xxhash64(F.lit(""), *table.partitions))
    if "*" in kinds:
        hand = F.pmod(F.xxhash64(*table.columns), F.lit(hands)).cast("int")
        keys.append(F.xxhash64(F.lit("*"), hand))
    if not keys:
        keys = [F.lit(None).cast("long")]
    key = F.explode(F.array(*keys)) if len(keys) > 1 else keys[0]
    rows = rows.select(*table.columns, key.alias("key"))
    asked = F.broadcast(asked) if size <= BROADCAST_BYTES else asked.hint("merge")
    checks = [_meets(F.col(f"row.{c}"), F.col(f"ask.{c}"), table.columns[c], forms[c]) for c in used]
    return (rows.alias("row").join(asked.alias("ask"), all_of([F.col("row.key") == F.col("ask.key"), *checks]))
            .select("request_id", *[f"row.{c}" for c in table.columns]))


def _meets(value: Column, asks: Column, declared: str, forms: frozenset[str]) -> Column:
    """The value meets all conditions on its column, which have no other forms than these."""
    number, read = _readers(value, declared)
    text = declared in TEXT_TYPES

    def meets(ask: Column) -> Column:
        def among(values: Column) -> Column:
            return F.array_contains(values, value) if text else \
                F.exists(values, lambda v: F.coalesce(number == read(v), F.lit(False)))

        def side(end: str, strict: Column, loose: Column) -> Column:
            return F.when(ask[f"{end}_open"], strict).otherwise(loose) if f"{end}_open" in forms else loose

        tests = {"low": lambda: side("low", number > read(ask["low"]), number >= read(ask["low"])),
                 "high": lambda: side("high", number < read(ask["high"]), number <= read(ask["high"])),
                 "listed": lambda: among(ask["listed"]), "excluded": lambda: ~among(ask["excluded"]),
                 "part": lambda: value.contains(ask["part"]) if text else F.lit(False)}
        occurring = [f for f in FORMS if f in forms]
        something = any_of([ask[f].isNotNull() for f in occurring]) if occurring else F.lit(False)
        return F.coalesce(all_of([something, value.isNotNull(), *[ask[f].isNull() | tests[f]() for f in occurring]]), F.lit(False))

    return F.forall(asks, meets)


def _readers(value: Column, declared: str) -> tuple[Column, Callable[[Column], Column]]:
    """The value in the type it is compared in, and how request text is read into that type."""
    if declared in TEXT_TYPES:
        return value, lambda v: v
    if declared == "bool" or declared in WHOLE_RANGES:
        def exact(text: Column) -> Column:
            wide = F.trim(text).try_cast("double")
            edge = F.when(~F.isnan(wide) & (wide > _EDGE), F.lit(_EDGE)).when(wide < -_EDGE, F.lit(-_EDGE))
            return F.coalesce(F.trim(text).try_cast(_EXACT), edge.cast(_EXACT))

        return (value.cast("int") if declared == "bool" else value).cast(_EXACT), exact
    kind: T.DataType = TYPES[declared]
    return value, lambda v: F.when(~F.isnan(F.trim(v).try_cast(kind)), F.trim(v).try_cast(kind))
