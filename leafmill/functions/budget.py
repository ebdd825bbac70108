"""Token budgets of images: estimates from byte sizes, and the largest side length that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import bind

#: base64 characters to a token, smallest estimated size, steps that any search ends within.
CHARS_PER_TOKEN, LEAST_BYTES, SEARCH_STEPS = 3.5, 1024, 32


def tokens_for_size(size: Column) -> Column:
    """Tokens of so many bytes as base64; one at least."""
    chars = F.floor((size + 2) / 3) * 4
    return F.greatest(F.lit(1), F.ceil(chars / F.lit(CHARS_PER_TOKEN))).cast("long")


def estimate_image_tokens(size: Column) -> Column:
    """tokens_for_size(); 0 for an image that isn't there (null)."""
    return F.when(size.isNull(), F.lit(0)).otherwise(tokens_for_size(size)).cast("long")


def size_at_side(size: Column, original: Column, target: Column) -> Column:
    """Estimated bytes at another length of the long side; the size itself where size or side isn't positive."""
    ratio = target / original.cast("double")
    shrunk = F.greatest(F.lit(LEAST_BYTES), (size * F.pow(ratio, F.lit(2.0))).cast("long"))
    return F.when(size.isNotNull(), F.when((original <= 0) | (size <= 0), size).otherwise(shrunk)).cast("long")


def fallback_side(size: Column) -> Column:
    """Side of the square that stands for an image of unknown dimensions."""
    return F.when(size <= 0, F.lit(256)).when(size.isNotNull(), F.greatest(F.lit(256), (2 * F.sqrt(size.cast("double"))).cast("int"))).cast("int")


def long_side(width: Column, height: Column, size: Column) -> Column:
    return F.coalesce(F.greatest(width, height), fallback_side(size)).cast("int")


def plan_for_image(ctx_limit: Column, persona_tokens: Column, fixed_text_tokens: Column, image_bytes: Column, width: Column, height: Column, target: int = 1536, least: int = 768, safety: float = 0.85) -> Column:
    """struct(total, limit, fits, needed_long_side, reason) for the call that carries the image.

    An image that fits as it is gets the target side. Else the side is searched between `least` and its own by
    halving, down to 4 pixels: the search and not a closed form defines the result. An image no longer than `least`
    can't be helped. A null or empty image has no tokens."""
    if not 0 < safety <= 1:
        raise ValueError(f"safety must be in (0, 1], got {safety!r}")
    if target < 1 or least < 1 or target < least:
        raise ValueError(f"need 1 <= least <= target, got target={target}, least={least}")
    size = F.coalesce(image_bytes, F.lit(0)).cast("long")
    given = F.struct(
        F.floor(ctx_limit * F.lit(safety)).cast("long").alias("limit"), (persona_tokens + fixed_text_tokens).cast("long").alias("text"),
        size.alias("size"), F.when(size > 0, tokens_for_size(size)).otherwise(F.lit(0)).cast("long").alias("tokens"), long_side(width, height, size).alias("side"),
    )

    def decision(x: Column, image: Column, needed: Column, reason: Column, fits: Column | None = None) -> Column:
        total = x.text + image
        return F.struct(total.alias("total"), x.limit.alias("limit"), F.coalesce(fits if fits is not None else total <= x.limit, F.lit(False)).alias("fits"), needed.cast("int").alias("needed_long_side"), reason.alias("reason"))

    def planned(x: Column) -> Column:
        return bind(F.greatest(F.lit(0), x.limit - x.text), lambda budget: chosen(x, budget))

    def chosen(x: Column, budget: Column) -> Column:
        whole = decision(x, x.tokens, F.lit(target), F.lit("image fits within budget at original size"), F.lit(True))
        small = decision(x, x.tokens, x.side, F.lit(f"image already smaller than min_long_side={least}; fixed-text budget is too tight"), F.lit(False))
        return F.when(x.tokens <= budget, whole).when(x.side <= least, small).otherwise(bind(search(x, budget), lambda best: shrunk(x, budget, best)))

    def shrunk(x: Column, budget: Column, best: Column) -> Column:
        reason = F.format_string("downscaled from %dpx to %dpx to fit budget=%d image tokens", x.side, best, budget)
        return bind(tokens_for_size(size_at_side(x.size, x.side, best)), lambda tokens: decision(x, tokens, best, reason))

    def search(x: Column, budget: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            return F.when(s.high - s.low <= 4, s).otherwise(bind(F.floor((s.low + s.high) / 2).cast("int"), lambda mid: halved(s, mid)))

        def halved(s: Column, mid: Column) -> Column:
            fits = tokens_for_size(size_at_side(x.size, x.side, mid)) <= budget
            return F.when(fits, F.struct(mid.alias("low"), s.high.alias("high"))).otherwise(F.struct(s.low.alias("low"), mid.alias("high")))

        begun = F.struct(F.lit(least).alias("low"), x.side.alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(SEARCH_STEPS)), begun, step, lambda s: s.low)

    return bind(given, planned)


def needs_resize(plan: Column, image_side: int) -> Column:
    return ~plan.fits | (plan.needed_long_side < image_side)


def attach_side(plan: Column, image_side: int) -> Column:
    """The side at which an image is attached: never over the configured one."""
    return F.least(plan.needed_long_side, F.lit(image_side))
