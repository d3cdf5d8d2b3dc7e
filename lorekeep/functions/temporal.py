"""Trust and time as column expressions; sessions are expected to run in UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep import schema as S
from lorekeep.functions.text import blank, col, strip

DATE = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([Zz]|[+-]\d{2}:\d{2})?)?$"


def trust_tier(verified) -> Column:
    """human-reviewed if anyone `human:` verified, machine-confirmed if any entry is there, else unverified."""
    v = col(verified)
    human = F.exists(v, lambda e: F.coalesce(e["by"].startswith("human:"), F.lit(False)))
    return F.when(v.isNull() | (F.size(v) <= 0), "unverified").when(human, "human-reviewed").otherwise("machine-confirmed")


def tier_rank(tier) -> Column:
    return F.when(col(tier) == "human-reviewed", 3).when(col(tier) == "machine-confirmed", 2).otherwise(1)


def trust_bucket(tier) -> Column:
    return F.when(col(tier) == "human-reviewed", "high").when(col(tier) == "machine-confirmed", "medium").otherwise("low")


def is_human(actor) -> Column:
    return F.coalesce(col(actor).startswith("human:"), F.lit(False))


def actor_name(actor) -> Column:
    return F.regexp_replace(col(actor), "^[^:]*:", "")


def parse_temporal(c) -> Column:
    """ISO-8601 text to a UTC timestamp; null for anything else. A bare date is its midnight."""
    t = strip(c)
    shaped = (F.length(t) <= 100) & t.rlike(INSTANT)
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.upper(t), ",", "."), r"^(\d{4}-\d{2}-\d{2}) ", "$1T")))


def is_date_only(c) -> Column:
    return strip(c).rlike(DATE)


def window_end(c) -> Column:
    """A bare date covers its whole day."""
    t = parse_temporal(c)
    return F.when(is_date_only(c), t + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '1' MICROSECOND")).otherwise(t)


def normalize_supersedes(c) -> Column:
    """The first hundred entries, trimmed, without blanks."""
    return F.filter(F.transform(F.slice(F.coalesce(col(c), F.array().cast("array<string>")), 1, S.MAX_SUPERSEDES), strip), lambda x: F.coalesce(x != "", F.lit(False)))


def has_temporal(valid_from="valid_from", valid_until="valid_until", supersedes="supersedes", last_verified="last_verified") -> Column:
    return ~blank(valid_from) | ~blank(valid_until) | (F.size(normalize_supersedes(supersedes)) > 0) | ~blank(last_verified)


def window_status(valid_from, valid_until, at) -> Column:
    """Both ends belong to the window."""
    start, end = parse_temporal(valid_from), window_end(valid_until)
    return F.when(F.coalesce(col(at) < start, F.lit(False)), "not_yet_valid").when(F.coalesce(col(at) > end, F.lit(False)), "expired").otherwise("current")


def temporal_mark(status, head) -> Column:
    return F.when(col(status) == "superseded", F.concat_ws(" by ", F.lit("superseded"), col(head))).when(col(status) == "not_yet_valid", "not yet valid").when(col(status) == "expired", "expired")


def is_calendar_date(c) -> Column:
    return col(c).rlike(DATE) & F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd")).isNotNull()


def has_offset(c) -> Column:
    """ISO timestamp with an explicit offset, as audit fields need it."""
    return F.coalesce(strip(c).rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([Zz]|[+-]\d{2}:\d{2})$") & parse_temporal(c).isNotNull(), F.lit(False))
