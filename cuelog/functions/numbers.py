"""Number and time scalars: timestamps, speeds, delays, timeouts and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let


def round_exact(value, digits: int) -> Column:
    """A double to ``digits`` decimals as its exact binary value asks for, half to even: what Python's ``round`` gives.

    ``bround`` rounds the shortest decimal text instead, which may be a tie where the value is none:
    3.755 / 8 prints as 0.469375 and is a little less.  The product with 10 ** (digits + 1) and its rounding
    error (Dekker's two-part product) tell on which side of the tie the value lies.
    """
    scale, split = 10.0 ** (digits + 1), 134217729.0
    high = scale * split - (scale * split - scale)
    low = scale - high

    def near(v: Column) -> Column:
        x, product, top = v["x"], v["product"], v["top"]
        bottom = x - top
        error = ((top * high - product) + top * low + bottom * high) + bottom * low
        whole = F.rint(product)
        return let(lambda w: F.when(
            (F.abs(w["whole"] % 10) == 5) & (F.abs(product - w["whole"]) < 0.25) & (F.abs(product) < float(1 << 52)),
            F.rint(F.when(w["side"] > 0, w["whole"] + 1).when(w["side"] < 0, w["whole"] - 1).otherwise(w["whole"]) / 10) / 10.0 ** digits,
        ).otherwise(F.bround(x, digits)), whole=whole, side=(product - whole) + error)

    return let(near, x=_col(value), product=_col(value) * scale, top=_col(value) * split - (_col(value) * split - _col(value)))


def finite(value) -> Column:
    """A double, or NULL for text, NaN and infinities."""
    number = _col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def frame_rate(value) -> Column:
    """'30000/1001' or '25' as frames per second; NULL unless positive."""
    parts = F.split(_col(value), "/")
    top = F.get(parts, F.lit(0)).try_cast("double")
    bottom = F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    rate = finite(F.try_divide(top, bottom))
    return F.when(rate > 0, rate)


def fmt_time(seconds) -> Column:
    """MM:SS; minutes may pass 59."""
    total = F.floor(F.greatest(F.lit(0.0), F.coalesce(_col(seconds), F.lit(0.0)))).cast("bigint")
    return F.concat(_two(F.floor(total / 60)), F.lit(":"), _two(total % 60))


def _two(number: Column) -> Column:
    text = number.cast("bigint").cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def srt_timestamp(seconds) -> Column:
    """HH:MM:SS,mmm rounded half to even."""
    ms = F.greatest(F.lit(0), F.bround(F.coalesce(_col(seconds), F.lit(0.0)) * 1000, 0).cast("bigint"))
    return F.concat(
        _two(F.floor(ms / 3600000)), F.lit(":"), _two(F.floor(ms / 60000) % 60), F.lit(":"),
        _two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def fmt_elapsed(seconds) -> Column:
    """H:MM:SS or M:SS; a dash when unknown or zero."""
    value = finite(seconds)
    whole = F.bround(value, 0).cast("bigint")
    hours, minutes, secs = F.floor(whole / 3600).cast("bigint"), F.floor(whole / 60) % 60, whole % 60
    short = F.concat(F.floor(whole / 60).cast("bigint").cast("string"), F.lit(":"), _two(secs))
    long = F.concat(hours.cast("string"), F.lit(":"), _two(minutes), F.lit(":"), _two(secs))
    return F.when(value.isNull() | (value <= 0), F.lit("—")).when(hours > 0, long).otherwise(short)


def fmt_clock(iso_text) -> Column:
    """ISO time as 'YYYY-MM-DD HH:MM:SS'; a dash when empty."""
    text = F.trim(F.coalesce(_col(iso_text).cast("string"), F.lit("")))
    return F.when(text == "", F.lit("—")).otherwise(F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 19))


def edge_rate(speed, limit=1.15, max_rate: float = 0.25) -> Column:
    """Percent of speed-up asked from the synthesiser itself."""
    speed, limit = _col(speed), limit if isinstance(limit, Column) else F.lit(limit)
    allowed = F.least(F.lit(max_rate), F.greatest(F.lit(0.0), limit - 1.0)) * 100
    rate = F.least(allowed, F.bround((speed - 1.0) * 100, 0))
    return F.when(speed <= 1.04, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), rate))).cast("int")


def tempo_chain(speed) -> Column:
    """A speed (.25-8) as factors that each lie within .5-2."""
    speed = F.greatest(F.lit(0.25), F.least(F.lit(8.0), F.when(_col(speed) == 0, 1.0).otherwise(_col(speed))))
    two, half = F.lit(2.0), F.lit(0.5)
    return (F.when(speed > 4, F.array(two, two, speed / 4))
            .when(speed > 2, F.array(two, speed / 2))
            .when(speed < 0.5, F.array(half, speed / 0.5))
            .otherwise(F.array(speed)))


def retry_delay(attempt, base: float = 1.5, maximum: float = 20.0) -> Column:
    """Doubling delay with an upper bound."""
    n = F.greatest(F.lit(1), F.coalesce(_col(attempt).cast("int"), F.lit(1)))
    return F.least(F.lit(float(maximum)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(30))))


def provider_retry_delay(category, attempt) -> Column:
    """Delay by error category: rate limits linear, network at least 12 s."""
    category, n = _col(category), F.greatest(F.lit(1), _col(attempt).cast("int"))
    return (F.when(category == "rate_limit", F.least(F.lit(60.0), n * 8.0))
            .when(category.isin("network_timeout", "network_connection", "timeout"),
                  F.greatest(F.lit(12.0), retry_delay(attempt)))
            .otherwise(retry_delay(attempt)))


def tts_timeout(text) -> Column:
    length = F.length(F.coalesce(_col(text), F.lit("")))
    return F.greatest(F.lit(45), F.least(F.lit(180), 45 + F.floor(length * 0.12).cast("int")))


def encode_timeout(duration, pauses) -> Column:
    work = F.floor(_positive(duration) * 2.2 + F.greatest(F.lit(0), _col(pauses)) * 3 + 900).cast("bigint")
    return F.least(F.lit(8 * 3600).cast("bigint"), F.greatest(F.lit(3600).cast("bigint"), work))


def audio_timeout(duration, minimum: int = 360, factor: float = 0.75, extra: int = 240) -> Column:
    work = F.floor(_positive(duration) * factor + extra).cast("bigint")
    return F.least(F.lit(8 * 3600).cast("bigint"), F.greatest(F.lit(minimum).cast("bigint"), work))


def _positive(value) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(_col(value), F.lit(0.0)))


def storm_pause(round_no, initial: int = 30) -> Column:
    return F.least(F.lit(60), initial + (_col(round_no) - 1) * 15)


def circuit_cooldown(base, streak) -> Column:
    """Doubling cool-down for rate limits, at most 16-fold and 900 s."""
    power = F.least(F.greatest(_col(streak) - 1, F.lit(0)), F.lit(4))
    return F.least(_positive(base) * F.pow(F.lit(2.0), power), F.lit(900.0))


def translation_progress(done, total) -> Column:
    return (30 + F.floor(_col(done) / F.greatest(F.lit(1), _col(total)) * 22)).cast("int")


def synthesis_progress(done, total) -> Column:
    return (55 + F.floor(_col(done) / F.greatest(F.lit(1), _col(total)) * 28)).cast("int")
