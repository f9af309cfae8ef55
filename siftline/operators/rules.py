"""Rule cascades and scores as CASE expressions: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def clamp(c: Column) -> Column:
    """A score rounded into 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(c)))


def rank(place, remote, themes, apply, official, prize, student, authority, has_start, metro) -> Column:
    """The preference score: conditions add their weights to 40."""
    total = (
        F.lit(40) + 25 * _flag(place) + 20 * _flag(remote) + F.least(10 * themes, F.lit(30)) + 10 * _flag(apply) + 10 * _flag(official)
        + 8 * _flag(prize) + 8 * _flag(student) + 8 * _flag(authority >= 70) - 10 * (1 - _flag(has_start)) + 5 * _flag(metro)
    )
    return clamp(total).cast("int")


#: Words that place a failure message, in order of precedence.
FAILURES = [
    ("missing_api_key", "missing.?api.?key|not configured|search_provider|search_api_key|unconfigured"), ("rate_limit", "rate.?limit|too many requests|429"),
    ("anti_bot", "cloudflare|captcha|access denied|blocked|anti-?bot|bot detection|403 forbidden"),
    ("network", "enotfound|econnrefused|econnreset|etimedout|network|fetch failed|socket|dns|getaddrinfo"),
    ("browser_missing", "playwright|browser.*not installed|executable doesn't exist"), ("profile_missing", "profile.?missing|no browser profile|profile directory"),
    ("auth_required", "login|sign in|credentials|auth(?:entication)? required|session expired|reconnect"),
    ("selector_parser_failure", "selector|parser|parse failed|ui may have changed|no visible cards|markup|dom"),
    ("no_current_events", "no current|no upcoming|ended|no events"), ("zero_matching_results", "no promising|zero|no .*results|returned no"),
]


def failure_category(message: Column) -> Column:
    """The first category whose words a message holds; null if none."""
    low, out = F.lower(message), None
    for name, pattern in FAILURES:
        value = F.when(low.rlike("expired|reconnect"), "session_expired").otherwise(name) if name == "auth_required" else F.lit(name)
        out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out


def source_health(leads: Column, errors: Column, warnings: Column, signed_in: Column) -> Column:
    """(status, category) of a scan; errors and warnings are joined messages, null if there are none."""
    joined = F.concat_ws(" | ", errors, warnings)
    category = failure_category(joined)

    def verdict(status, kind):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(lit(status).alias("status"), lit(kind).alias("category"))

    failed = F.coalesce(category, F.lit("unknown"))
    of_error = (
        F.when(failed.isin("auth_required", "session_expired"), "auth_required").when(failed.isin("missing_api_key", "profile_missing"), "unconfigured")
        .when(failed.isin("rate_limit", "anti_bot"), "degraded").otherwise("failed")
    )
    quiet = F.coalesce(category, F.lit("zero_matching_results"))
    of_nothing = F.when(quiet.isin("auth_required", "session_expired"), "auth_required").when(quiet.isin("missing_api_key", "profile_missing"), "unconfigured").otherwise("degraded")
    shut_out = ~signed_in & joined.rlike("(?i)login|sign in|authentication required|auth_required|credentials")
    doubtful = warnings.isNotNull() & joined.rlike("(?i)selector|parser|ui may have changed|timeout|partial")
    return (
        F.when(errors.isNotNull(), verdict(of_error, failed))
        .when(shut_out, verdict("auth_required", F.when(joined.rlike("(?i)expired|reconnect"), "session_expired").otherwise("auth_required")))
        .when((leads > 0) & F.coalesce(doubtful, F.lit(False)), verdict("degraded", category))
        .when(leads > 0, verdict("healthy", None))
        .otherwise(verdict(of_nothing, quiet))
    )


#: What a reviewer may do to a record, by status; anything else may only be restored.
ACTIONS = {
    "NEW": ["approve", "save", "reject"], "NEEDS_REVIEW": ["approve", "save", "reject"], "APPROVED": ["reject", "save", "restore"],
    "REJECTED": ["approve", "save", "restore"], "SAVED_FOR_LATER": ["approve", "reject", "unsave", "restore"],
}


def allowed_actions(status: Column) -> Column:
    """What a reviewer may do to a record of this status, in the order shown."""
    out = None
    for name, actions in ACTIONS.items():
        value = F.array(*[F.lit(a) for a in actions])
        out = F.when(status == name, value) if out is None else out.when(status == name, value)
    return out.otherwise(F.array(F.lit("restore")))
