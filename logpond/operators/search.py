"""Log search: filters, paginated page, total count and the JSON response
(F1-F9, T1-T3, A11, S10).

The filter becomes one Catalyst predicate. When the logs DataFrame carries
the ``log_date`` partition column, a matching date range is added so that a
time filter prunes whole partitions (a predicate on ``ts`` alone cannot).
The page is ``orderBy(...).offset(o).limit(n)``, which Spark plans as a
distributed top-k (``TakeOrderedAndProject``): every task keeps only its best
``offset + limit`` rows, so no task ever sorts the whole table.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logpond import schema as S
from logpond.functions.values import unflatten_attrs
from logpond.session import written

_ORDER_COLUMNS = {"Timestamp": "ts", "ServiceName": "service_name"}


@dataclass
class LogFilter:
    start: dt.datetime | str | None = None      # inclusive
    end: dt.datetime | str | None = None        # inclusive
    service_name: str = ""                      # case-insensitive prefix
    severity_text: str = ""                     # case-insensitive prefix
    trace_id: str = ""                          # case-insensitive prefix
    span_id: str = ""                           # case-insensitive prefix
    severity_number: int = -1                   # equality when > 0
    body: str = ""                              # case-insensitive substring
    order_by: str = S.DEFAULT_ORDER_FIELD       # "Timestamp" | "ServiceName"
    descending: bool = False
    limit: int = 0                              # 0 -> 100
    offset: int = 0                             # < 0 -> 0
    literal: bool = False                       # escape % and _ in user text
    extra: dict = field(default_factory=dict)

    @property
    def order_column(self) -> str:
        return _ORDER_COLUMNS.get(self.order_by, "ts")

    @property
    def page_limit(self) -> int:
        return self.limit if self.limit != 0 else S.DEFAULT_PAGE_LIMIT

    @property
    def page_offset(self) -> int:
        return max(self.offset, 0)


def _escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _ts(v) -> Column:
    # naive datetimes are wall-clock UTC; go through text so the Python
    # process's local zone never applies
    if isinstance(v, dt.datetime):
        v = v.isoformat(sep=" ")
    return F.lit(str(v)).cast("timestamp")


_HEX = re.compile(r"^[0-9a-fA-F]+$")


def _id_prefix(col: str, value: str, width: int, pattern: str) -> Column:
    """Ids are stored in lower case, so a hexadecimal prefix is a range and a
    whole id an equality: both reach the scan's statistics, a pattern does
    not. Anything else (with wildcards, say) stays a pattern."""
    if not _HEX.match(value) or len(value) > width:
        return F.col(col).ilike(pattern)
    low = value.lower()
    if len(low) == width:
        return F.col(col) == low
    return (F.col(col) >= low) & (F.col(col) < low[:-1] + chr(ord(low[-1]) + 1))


def filter_condition(f: LogFilter, has_log_date: bool = False) -> Column:
    """All present predicates ANDed; an empty filter is ``TRUE``."""
    conds: list[Column] = []
    esc = _escape_like if f.literal else (lambda s: s)
    if f.start:
        conds.append(F.col("ts") >= _ts(f.start))
        if has_log_date:
            conds.append(F.col("log_date") >= F.to_date(_ts(f.start)))
    if f.end:
        conds.append(F.col("ts") <= _ts(f.end))
        if has_log_date:
            conds.append(F.col("log_date") <= F.to_date(_ts(f.end)))
    for col, value in (("service_name", f.service_name), ("severity_text", f.severity_text)):
        if value:
            conds.append(F.col(col).ilike(esc(value) + "%"))
    for col, value, width in (("trace_id", f.trace_id, S.TRACE_ID_HEX_LEN), ("span_id", f.span_id, S.SPAN_ID_HEX_LEN)):
        if value:
            conds.append(_id_prefix(col, value, width, esc(value) + "%"))
    if f.severity_number > 0:
        conds.append(F.col("severity_number") == F.lit(int(f.severity_number)))
    if f.body:
        conds.append(F.col("body").ilike("%" + esc(f.body) + "%"))
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


#: A prefix that matches more services than this stays a pattern.
MAX_SERVICES = 1000


def services_with_prefix(registry: DataFrame, f: LogFilter) -> list[str] | None:
    """F3 through the registry: the service names that the filter's prefix
    matches (at most ``MAX_SERVICES``; None beyond that)."""
    esc = _escape_like if f.literal else (lambda s: s)
    names = [r["service_name"] for r in registry.where(F.col("service_name").ilike(esc(f.service_name) + "%"))
             .select("service_name").distinct().orderBy("service_name").limit(MAX_SERVICES + 1).collect()]
    return names if len(names) <= MAX_SERVICES else None


def apply_filter(logs: DataFrame, f: LogFilter, registry: DataFrame | None = None) -> DataFrame:
    """Rows that match. With the service registry a service prefix becomes the
    list of its services, which reaches the scan's statistics; the registry
    must know every service of ``logs``, as the ingest's own does."""
    if registry is not None and f.service_name:
        names = services_with_prefix(registry, f)
        if names is not None:
            return logs.filter(filter_condition(replace(f, service_name=""), "log_date" in logs.columns)
                               & (F.col("service_name").isin(names) if names else F.lit(False)))
    return logs.filter(filter_condition(f, "log_date" in logs.columns))


def errors_only(logs: DataFrame) -> DataFrame:
    """error rows (severity number >= 17)."""
    return logs.filter(F.col("severity_number") >= S.ERROR_SEVERITY_MIN)


def page_key(logs: DataFrame, f: LogFilter) -> Column:
    """The total order of a search, as one struct: time to the nanosecond or
    service, the ids, and what tells rows apart that share all of these: the
    arrival (``arrival_seq`` of ingested rows), an ``event_id``, or else a hash
    of the whole row, which only equal rows share."""
    first = ([F.unix_micros("ts").alias("ts"), F.col("ts_nanos")] if f.order_column == "ts"
             else [F.col(f.order_column)])
    if "arrival_seq" in logs.columns:
        last = F.col("arrival_seq")
    elif "event_id" in logs.columns:
        last = F.col("event_id")
    else:
        last = F.xxhash64(*logs.columns).alias("row_hash")
    return F.struct(*first, F.col("trace_id"), F.col("span_id"), last)


def _ordered(rows: DataFrame, f: LogFilter) -> DataFrame:
    key = F.col("page_key")
    return rows.orderBy(key.desc() if f.descending else key.asc())


def search_page(logs: DataFrame, f: LogFilter, after: str | None = None) -> DataFrame:
    """T1, deep paging: the page that follows the token ``after`` (the first
    page without one), with the column ``page_key``. Every task keeps
    ``limit`` rows however far the paging goes, and the bound on the first
    sort column reaches the scan. ``next_token`` makes the token."""
    rows = apply_filter(logs, f).withColumn("page_key", page_key(logs, f))
    if after is None:
        return _ordered(rows, f).limit(f.page_limit)
    token = json.loads(after)
    there = F.from_json(F.lit(json.dumps(token["key"])), rows.schema["page_key"].dataType)
    here = F.col("page_key")
    rows = rows.filter(here <= there if f.descending else here >= there)
    # nulls are the smallest values: first when ascending, last when descending
    first, bound = F.col(f.order_column), token["key"].get(f.order_column)
    if bound is not None:
        edge = F.timestamp_micros(F.lit(bound)) if f.order_column == "ts" else F.lit(bound)
        rows = rows.filter((first <= edge) | first.isNull() if f.descending else first >= edge)
    elif f.descending:
        rows = rows.filter(first.isNull())
    # equal keys mean equal rows: as many of them as were seen are passed over
    return _ordered(rows, f).offset(token["seen"]).limit(f.page_limit)


def last_rows(page: DataFrame, f: LogFilter) -> list:
    """The rows of a stored page that ``next_token`` needs: those that share
    the last key (at most a page)."""
    key = F.col("page_key")
    last = page.select((F.min(key) if f.descending else F.max(key)).alias("k")).first()["k"]
    if last is None:
        return []
    there = F.from_json(F.lit(json.dumps(last.asDict(recursive=True))), page.schema["page_key"].dataType)
    return page.where(key == there).select("page_key").collect()


def next_token(page: list, after: str | None = None) -> str | None:
    """The token for the page behind this one (its rows, collected), or None
    when it is empty."""
    if not page:
        return None
    key = page[-1]["page_key"].asDict(recursive=True)
    seen = 0
    for row in reversed(page):
        if row["page_key"].asDict(recursive=True) != key:
            break
        seen += 1
    before = json.loads(after) if after else None
    if seen == len(page) and before and before["key"] == key:
        seen += before["seen"]
    return json.dumps({"key": key, "seen": seen})


def search_logs(logs: DataFrame, f: LogFilter) -> DataFrame:
    """One page of matching rows by offset. Ties beyond the order field
    are broken by ``page_key``, so pages do not overlap."""
    rows = apply_filter(logs, f).withColumn("page_key", page_key(logs, f))
    return _ordered(rows, f).offset(f.page_offset).limit(f.page_limit).drop("page_key")


def search_count(logs: DataFrame, f: LogFilter) -> DataFrame:
    """Number of rows matching the filter (one row, column ``total``)."""
    return apply_filter(logs, f).agg(F.count(F.lit(1)).alias("total"))


def record_struct(df: DataFrame) -> Column:
    """API shape of one record (attributes as key/value lists)."""
    return F.struct(
        _nano_text("ts", "ts_nanos").alias("timestamp"),
        _nano_text("observed_ts", "observed_ts_nanos").alias("observedTimestamp"),
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("severity_text").alias("severityText"),
        F.col("severity_number").alias("severityNumber"),
        F.col("service_name").alias("serviceName"),
        F.col("body").alias("body"),
        F.col("body_type").alias("bodyType"),
        F.col("scope_name").alias("scopeName"),
        F.col("scope_version").alias("scopeVersion"),
        unflatten_attrs("log_attr_keys", "log_attr_values").alias("logAttributes"),
        unflatten_attrs("res_attr_keys", "res_attr_values").alias("resourceAttributes"),
    )


def _nano_text(ts: str, nanos: str) -> Column:
    """UTC time with as many fraction digits as it needs, up to nine."""
    n = F.pmod(F.coalesce(F.col(nanos), F.unix_micros(ts) * 1000), F.lit(1_000_000_000))
    fraction = F.regexp_replace(F.lpad(n.cast("string"), 9, "0"), "0+$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))


def search_page_with_total(logs: DataFrame, f: LogFilter) -> tuple[DataFrame, int]:
    """T1 + A11 in one scan: the filtered rows are counted by an
    ``Observation`` below the top-k, so computing the page also yields the
    total. The page (at most ``limit`` rows) is written to the checkpoint
    folder, so building the response from it does not scan again and no
    cache is left behind."""
    obs = Observation("search_total")
    counted = apply_filter(logs, f).observe(obs, F.count(F.lit(1)).alias("total")).withColumn("page_key", page_key(logs, f))
    page = written(_ordered(counted, f).offset(f.page_offset).limit(f.page_limit), "page")
    return _ordered(page, f), int(obs.get["total"])


def search_json(logs: DataFrame, f: LogFilter, total: int | None = None) -> DataFrame:
    """The search response ``{"data": [...], "meta": {"totalRowCount": n}}``
    as one JSON string. Page and total come from one scan
    (``search_page_with_total``); the page has at most ``limit`` rows, so
    gathering it into one row is bounded by the page size."""
    if total is None:
        page, total = search_page_with_total(logs, f)
    else:
        rows = apply_filter(logs, f).withColumn("page_key", page_key(logs, f))
        page = _ordered(rows, f).offset(f.page_offset).limit(f.page_limit)
    arr = F.array_sort(F.collect_list(F.struct(F.col("page_key").alias("k"), record_struct(page).alias("r"))))
    if f.descending:
        arr = F.reverse(arr)
    doc = page.agg(F.transform(arr, lambda x: x["r"]).alias("data"))
    return doc.select(F.to_json(F.struct(
        F.coalesce(F.col("data"), F.array()).alias("data"),
        F.struct(F.lit(int(total)).alias("totalRowCount")).alias("meta"))).alias("json"))


# ---------------------------------------------------------------------------
# Request parameter parsing (string parameters as a web API receives them)
# ---------------------------------------------------------------------------
_TIME_LAYOUT = "%Y-%m-%dT%H:%M:%S"
_TRUE = {"1", "t", "T", "TRUE", "true", "True"}
_FALSE = {"0", "f", "F", "FALSE", "false", "False"}
_INT = re.compile(r"^[+-]?[0-9]+$")


def _parse_int(name: str, s: str | None) -> int:
    if s is None or not _INT.match(s):
        raise ValueError(f"{name} must be a whole number, got {s!r}")
    return int(s)


def parse_search_params(params: dict[str, str]) -> LogFilter:
    """Build a ``LogFilter`` from string parameters. ``descending``,
    ``limit`` and ``offset`` are mandatory; a bad time, bool or integer
    raises ``ValueError``. Unknown order fields fall back to Timestamp."""
    def get(k):
        return params.get(k) or ""

    start = end = None
    if get("startTime"):
        try:
            start = dt.datetime.strptime(get("startTime"), _TIME_LAYOUT)
        except ValueError as e:
            raise ValueError(f"startTime must look like 2024-01-31T12:00:00, got {get('startTime')!r}") from e
    if get("endTime"):
        try:
            end = dt.datetime.strptime(get("endTime"), _TIME_LAYOUT)
        except ValueError as e:
            raise ValueError(f"endTime must look like 2024-01-31T12:00:00, got {get('endTime')!r}") from e
    order_by = get("orderBy") if get("orderBy") in S.ORDER_FIELDS else S.DEFAULT_ORDER_FIELD
    desc = params.get("descending")
    if desc in _TRUE:
        descending = True
    elif desc in _FALSE:
        descending = False
    else:
        raise ValueError(f"descending must be true or false, got {desc!r}")
    severity_number = _parse_int("severityNumber", get("severityNumber")) if get("severityNumber") else -1
    limit = _parse_int("limit", params.get("limit"))
    offset = _parse_int("offset", params.get("offset"))
    return LogFilter(start=start, end=end, service_name=get("serviceName"),
                     severity_text=get("severityText"), trace_id=get("traceId"),
                     span_id=get("spanId"), severity_number=severity_number, body=get("body"),
                     order_by=order_by, descending=descending, limit=limit, offset=offset)
