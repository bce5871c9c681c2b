"""Scalar Column expressions (built-in functions only, no UDFs).

Every function takes and returns Columns (strings are column names), so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

ColumnOrName = "Column | str"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# Whitespace as JavaScript's trim() and \s see it (ASCII and the common
# Unicode spaces).  PostgreSQL and Spark trim() strip the space only.
JS_WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def trim_ws(c) -> Column:
    """JS-style trim: all leading/trailing white space."""
    return F.regexp_replace(_c(c), rf"^{JS_WS}+|{JS_WS}+$", "")


def blank_to_null(c) -> Column:
    """nullif(trim(coalesce(x, '')), '') -- spaces only, as SQL trims."""
    return F.nullif(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))), F.lit(""))


def slug(c, strip: bool = True, fallback=None) -> Column:
    """URL-safe id.  strip=True is the client form (trim, lower, collapse
    non-alphanumerics to '-', strip edge '-', fallback when empty);
    strip=False is the SQL form (collapse, then lower, edges kept)."""
    col = _c(c).cast("string")
    if strip:
        s = F.lower(trim_ws(F.coalesce(col, F.lit(""))))
        s = F.regexp_replace(s, "[^a-z0-9]+", "-")
        s = F.regexp_replace(s, "^-+|-+$", "")
        if fallback is not None:
            s = F.coalesce(F.nullif(s, F.lit("")), _lit(fallback))
        return s
    return F.lower(F.regexp_replace(col, "[^a-zA-Z0-9]+", "-"))


def unquote(c) -> Column:
    """strip surrounding double quotes (trim(BOTH '"' FROM c))."""
    return F.btrim(_c(c), F.lit('"'))


def list_text(c, sep: str = ", ") -> Column:
    """list to text, nulls skipped, null list -> ''."""
    return F.array_join(F.coalesce(_c(c), F.array().cast("array<string>")), sep)


def text_list(c) -> Column:
    """comma text to list, spaces around commas removed (lateral split)."""
    return F.split(F.coalesce(_c(c), F.lit("")), r"\s*,\s*")


def clip(c, n: int) -> Column:
    """keep the first n characters."""
    return F.left(_c(c), F.lit(n))


_TRUE = ["t", "true", "y", "yes", "on", "1"]
_FALSE = ["f", "false", "n", "no", "off", "0"]


def bool_text(c, default=None) -> Column:
    """boolean from text with a default.  Accepts the SQL boolean
    literals (true/false, t/f, yes/no, y/n, on/off, 1/0; any case, spaces
    trimmed); anything else, or null, gives ``default``."""
    t = F.lower(F.trim(_c(c).cast("string")))
    v = F.when(t.isin(_TRUE), F.lit(True)).when(t.isin(_FALSE), F.lit(False))
    return v if default is None else F.coalesce(v, _lit(default))


def clamp(c, lo, hi) -> Column:
    """greatest(lo, least(c, hi)).  Both skip nulls (as in SQL), so a
    null c gives hi; callers coalesce first (T3 does)."""
    return F.greatest(_lit(lo), F.least(_c(c), _lit(hi)))


def to_utc_ntz(c) -> Column:
    """A timestamp column as a zone-free UTC wall clock (TIMESTAMP_NTZ)."""
    return _c(c).cast("timestamp_ntz")


def local_time(ts, tz: str = K.SHOP_TZ) -> Column:
    """UTC instant (NTZ, read as UTC) -> wall clock in ``tz`` (NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts))


def from_local(ts, tz: str = K.SHOP_TZ) -> Column:
    """Wall clock in ``tz`` (NTZ) -> UTC instant (NTZ)."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(ts))


def week_start(ts, tz: str = K.SHOP_TZ, n: int | Column = 0) -> Column:
    """F8: Monday 00:00 local of the week holding ``ts``, shifted ``n`` weeks
    in local time, returned as a UTC instant (NTZ).  Weeks holding a DST
    change are 167 or 169 hours long."""
    local = F.date_trunc("week", local_time(ts, tz))
    shifted = F.timestamp_add("WEEK", _lit(n), local) if not isinstance(n, int) or n else local
    return from_local(shifted, tz)


def jget(c, path: str) -> Column:
    """JSON member as text (``->>``)."""
    p = path if path.startswith("$") else "$." + path
    return F.get_json_object(_c(c), p)


def default_blank(c, d) -> Column:
    """coalesce(nullif(trim(c), ''), d)."""
    return F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), _lit(d))


def age_text(ts, as_of) -> Column:
    """'just now' / 'N min ago' / 'H hr ago' / 'H hr M min ago'; null -> ''."""
    t = _c(ts).cast("timestamp_ntz")
    a = _lit(as_of).cast("timestamp_ntz")
    micros = F.unix_micros(F.to_utc_timestamp(a, "UTC")) - F.unix_micros(F.to_utc_timestamp(t, "UTC"))
    minutes = F.greatest(F.lit(0), F.floor(micros / F.lit(60_000_000)).cast("long"))
    hours = F.floor(minutes / 60).cast("long")
    rem = minutes % 60
    out = (F.when(minutes < 1, F.lit("just now"))
           .when(minutes < 60, F.format_string("%d min ago", minutes))
           .when(rem == 0, F.format_string("%d hr ago", hours))
           .otherwise(F.format_string("%d hr %d min ago", hours, rem)))
    return F.when(t.isNull() | a.isNull(), F.lit("")).otherwise(out)


def orders_ahead(pos) -> Column:
    """greatest(0, pos - 1), null stays null."""
    p = _c(pos)
    return F.when(p.isNotNull(), F.greatest(F.lit(0), p - 1))


def wait_minutes(pos) -> Column:
    """4 minutes per order ahead."""
    return F.greatest(F.lit(0), _c(pos) - 1) * K.MINUTES_PER_ORDER


def wait_text(pos, status=None, board: bool = False) -> Column:
    """customer text ("You're up next" / "Estimated wait: ~N min");
    board=True gives the display form ("Now" for making, "~N min")."""
    p = F.coalesce(F.nullif(_c(pos), F.lit(0)), F.lit(1)) if board else _c(pos)
    ahead = F.greatest(F.lit(0), p - 1)
    txt = F.when(ahead == 0, F.lit("You're up next")).otherwise(
        F.format_string("Estimated wait: ~%d min" if not board else "~%d min",
                        ahead * K.MINUTES_PER_ORDER))
    if status is not None:
        txt = F.when(_c(status) == "making", F.lit("Now")).otherwise(txt)
    return txt


def ahead_text(pos) -> Column:
    """'No orders ahead of you.' / 'N order(s) ahead of you.'"""
    ahead = F.greatest(F.lit(0), _c(pos) - 1)
    return (F.when(ahead == 0, F.lit("No orders ahead of you."))
            .otherwise(F.format_string("%d order%s ahead of you.", ahead,
                                       F.when(ahead == 1, F.lit("")).otherwise(F.lit("s")))))


def words(c) -> Column:
    """Non-empty words of a text split on (JS) white space.  After the trim
    no word can be empty, so no per-element filter (lambda) is needed."""
    t = trim_ws(F.coalesce(_c(c), F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, JS_WS + "+"))


def first_name(c) -> Column:
    """first word, 'Guest' when there is none."""
    return F.coalesce(F.get(words(c), 0), F.lit(K.GUEST))


def word_count(c) -> Column:
    """number of words."""
    return F.size(words(c))


def order_summary(temp, label, milk, syrups) -> Column:
    """non-blank parts joined by ' · ' (syrups list joined by ', ')."""
    syr = F.when(F.size(F.coalesce(_c(syrups), F.array())) > 0, F.array_join(_c(syrups), ", "))
    parts = F.array(_c(temp), _c(label), _c(milk), syr)
    return F.when(F.coalesce(_c(label), F.lit("")) == "", F.lit("")).otherwise(
        F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " · "))


def status_label(c) -> Column:
    """F16: customer-facing status label."""
    s = _c(c)
    return (F.when(s == "making", F.lit(K.LABEL_MAKING))
            .when(s.isin(K.READY_STATUSES), F.lit(K.LABEL_READY))
            .otherwise(F.lit(K.LABEL_WAITING)))


def progress(c) -> Column:
    """F16: progress flags received/making/ready as a struct."""
    s = _c(c)
    return F.struct(
        F.coalesce(s.isin(K.STATUSES), F.lit(False)).alias("received"),
        F.coalesce(s.isin(K.STATUSES[1:]), F.lit(False)).alias("making"),
        F.coalesce(s.isin(K.READY_STATUSES), F.lit(False)).alias("ready"))


def ticket_no(pos) -> Column:
    """zero-padded to 3 digits, longer numbers kept whole."""
    p = _c(pos).cast("long")
    return F.when(p.isNotNull(), F.format_string("%03d", p))


def week_label(n) -> Column:
    """'This week' / 'Last week' / 'N week(s) ago|ahead'."""
    x = _c(n) if not isinstance(n, int) else F.lit(n)
    a = F.abs(x)
    return (F.when(x == 0, F.lit("This week")).when(x == -1, F.lit("Last week"))
            .otherwise(F.format_string("%d week%s %s", a,
                                       F.when(a == 1, F.lit("")).otherwise(F.lit("s")),
                                       F.when(x < 0, F.lit("ago")).otherwise(F.lit("ahead")))))


def week_range(start, end, tz: str = K.SHOP_TZ) -> Column:
    """'Mon d - Mon d' in local time, end minus one day."""
    s = local_time(start, tz)
    e = F.date_sub(F.to_date(local_time(end, tz)), 1)
    return F.when(_c(start).isNull() | _c(end).isNull(), F.lit("Selected week")).otherwise(
        F.concat(F.date_format(s, "MMM d"), F.lit(" - "), F.date_format(e, "MMM d")))


def url_component(c) -> Column:
    """encodeURIComponent: url_encode gives '+' for space and escapes
    !'()*~ ; put those back as JS leaves them."""
    e = F.url_encode(_c(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    for ch, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("*", "%2A"), ("~", "%7E")):
        e = F.replace(e, F.lit(code), F.lit(ch))
    return e


def ready_message(name, order_name, order_id, title: str = K.NOTIFY_TITLE) -> Column:
    """notification payload (title, body, orderId, url) as a struct;
    ``title`` is the shop's display name."""
    n = F.trim(_c(name))
    o = F.trim(_c(order_name))
    first = F.when(F.coalesce(n, F.lit("")) != "", F.format_string(K.READY_BODY_NAMED.replace("{name}", "%s"), n)) \
        .otherwise(F.lit(K.READY_BODY))
    second = F.when(F.coalesce(o, F.lit("")) != "", F.concat(F.lit("Order: "), o))
    body = F.concat_ws(" ", first, second)
    return F.struct(F.lit(title).alias("title"), body.alias("body"),
                    _c(order_id).alias("orderId"),
                    F.concat(F.lit("/?order="), url_component(_c(order_id))).alias("url"))


def cap_list(lst, allowed: Column | None = None, n: int = K.MAX_SYRUPS) -> Column:
    """keep items found in ``allowed`` (an array column), at most n."""
    l = F.coalesce(_c(lst), F.array().cast("array<string>"))
    if allowed is not None:
        l = F.filter(l, lambda x: F.coalesce(F.array_contains(allowed, x), F.lit(False)))
    return F.slice(l, 1, n)


def position_or(pos, ahead) -> Column:
    """the given position, else ahead + 1, else null."""
    return F.coalesce(F.nullif(_c(pos), F.lit(0)), _c(ahead) + 1)


def row_json(cols: list[str] | None = None) -> Column:
    """the row as JSON text, nulls kept (jsonb keeps them)."""
    s = F.struct(*[F.col(c) for c in cols]) if cols else F.struct(F.col("*"))
    return F.to_json(s, {"ignoreNullFields": "false"})


def whitelist(c, allowed=K.ALLOWED_TEMPS, default=K.DEFAULT_TEMPS) -> Column:
    """Allowed values that occur in the list, in the allowed order;
    an empty result gives ``default``."""
    lst = _c(c)
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    kept = F.filter(allowed_arr, lambda x: F.coalesce(F.array_contains(lst, x), F.lit(False)))
    return F.when(F.size(kept) == 0, F.array(*[F.lit(d) for d in default])).otherwise(kept)


def distinct_list(c) -> Column:
    """Distinct values, first occurrence order kept."""
    return F.array_distinct(_c(c))


# F6 under its survey name (not Spark's bool_or aggregate)
bool_or = bool_text


def last_at_most(bounds: Column, key: Column) -> Column:
    """Index of the last of the sorted ``bounds`` that is not above ``key`` (0 where all are), by halving."""
    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(bounds, mid) <= key
        return F.when(s["hi"] - s["lo"] <= 1, s).when(up, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), halve)["lo"]
