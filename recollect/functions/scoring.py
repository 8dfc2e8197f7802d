"""Column functions of ranking, packing, budgets and the job state machine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_MS = 86_400_000
#: Weights of memory types in a pack.
TYPE_WEIGHTS = {"decision": 1.0, "lesson": 0.9, "fact": 0.7, "command": 0.6, "note": 0.4, "todo": 0.4, "event": 0.4}


@dataclass(frozen=True)
class Weights:
    """The weights of keyword, vector, importance, freshness and usefulness scores."""

    keyword: float = 0.4
    vector: float = 0.4
    importance: float = 0.1
    freshness: float = 0.1
    usefulness: float = 0.1


def freshness(created_at: Column, now_ms: int, decay_days: float = 30.0) -> Column:
    """e-folding by age; a time to come gives more than 1."""
    return F.exp(-((F.lit(now_ms) - created_at) / DAY_MS) / decay_days)


def minmax(score: Column, window=None) -> Column:
    """Scores between the lowest and the highest of all rows (or the window's); equal ones are 1, nulls 0."""
    over = window or Window.partitionBy(F.lit(0))
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(score.isNull(), 0.0).when(low == high, 1.0).otherwise((score - low) / (high - low))


def fuse(keyword: Column, vector: Column, importance: Column, fresh: Column, useful: Column, w: Weights) -> Column:
    zero = F.lit(0.0)
    return w.keyword * F.coalesce(keyword, zero) + w.vector * F.coalesce(vector, zero) + w.importance * importance + w.freshness * fresh + w.usefulness * F.coalesce(useful, F.lit(0.5))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def pack_score(kind: Column, importance: Column, created_at: Column, now_ms: int) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, kind), F.lit(0.4)) * freshness(created_at, now_ms) * importance


def shrink_budget(base: int, chars: Column) -> Column:
    """The whole budget up to 4000 characters of prompt, then linearly less, 300 at least."""
    left = F.greatest(F.lit(0.0), 1 - (chars - 4000) / 16000)
    return F.when(chars <= 4000, F.lit(base)).otherwise(F.greatest(F.lit(300), F.round(base * left))).cast("long")


def estimate_usd(chars: Column) -> Column:
    return F.ceil(chars / 4) * 2e-6 + 500 * 2e-6


#: Dollars per million tokens in and out.
PRICES = {"gpt-4.1": (2.5, 10.0), "gpt-4.1-mini": (0.15, 0.6), "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6)}


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    def price(i: int) -> Column:
        prices = F.create_map(*[F.lit(x) for name, p in PRICES.items() for x in (name, p[i])])
        return F.coalesce(F.try_element_at(prices, model), F.lit(0.0))

    return tokens_in / 1e6 * price(0) + tokens_out / 1e6 * price(1)


def backoff_ms(failures: Column, base_ms: int = 30_000, cap_ms: int = 900_000) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), failures), F.lit(float(cap_ms))).cast("long")


#: Parts of error messages. Those of deterministic errors that no lower-case message can hold are left out.
TRANSIENT = ("econnrefused", "etimedout", "econnreset", "enetunreach", "ehostunreach", "epipe", "rate limit", "rate-limit", "ratelimit", "429", "500", "502", "503", "504")
DETERMINISTIC = ("zod", "json parse", "json.parse", "unexpected token", "unexpected end of json", "invalid json", "parse error", "parse fail", "schema", "validation fail", "validation error", "400", "401", "403", "404", "422")


def classify_error(message: Column) -> Column:
    low = F.lower(message)
    any_of = lambda parts: F.greatest(*[low.contains(p) for p in parts])
    return F.when(any_of(TRANSIENT), "transient").when(any_of(DETERMINISTIC), "deterministic").otherwise("transient")


def next_state(kind: Column, attempts: Column) -> Column:
    """(state, attempts, delay_ms) of a job after a failure of its kind."""
    more = attempts + 1
    delay = F.least(F.lit(1000) * F.pow(F.lit(2.0), attempts), F.lit(60_000.0)).cast("long")
    return (
        F.when(kind == "budget", F.struct(F.lit("paused").alias("state"), attempts.alias("attempts"), F.lit(0).cast("long").alias("delay_ms")))
        .when((kind == "deterministic") | (more >= 3), F.struct(F.lit("poison").alias("state"), more.alias("attempts"), F.lit(0).cast("long").alias("delay_ms")))
        .otherwise(F.struct(F.lit("pending").alias("state"), more.alias("attempts"), delay.alias("delay_ms")))
    )
