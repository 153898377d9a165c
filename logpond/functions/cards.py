"""Dashboard card rules (P18-P20) on one-row panel outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpond import schema as S
from logpond.functions.text import _round_half_up, fixed, short_number


def log_rate_card(stats: DataFrame) -> DataFrame:
    """P18 on ``log_rate_stats`` output."""
    pct = (F.col("ratio") - 1) * 100
    absolute = F.format_string("%.0f", _round_half_up(F.abs(pct), 0))
    delta = (F.when(F.col("avg_rate") == 0, F.lit("No logs received in the past minute."))
             .when(pct > 0, F.concat(F.lit("↑ "), absolute, F.lit("% vs 60s avg")))
             .when(pct < 0, F.concat(F.lit("↓ "), absolute, F.lit("% vs 60s avg")))
             .otherwise(F.lit("~ 0% vs 60s avg")))
    level = (F.when(F.col("avg_rate") == 0, F.lit("silent")).when(pct > 0, F.lit("up"))
             .when(pct < 0, F.lit("down")).otherwise(F.lit("flat")))
    return stats.select(short_number("current_rate").alias("value"), delta.alias("delta"), level.alias("level"))


def error_level(rate: DataFrame) -> DataFrame:
    """P19 on ``error_rate`` output (percent)."""
    r = F.col("current_rate")
    text = (F.when(r < S.ERROR_LEVEL_NORMAL_BELOW, F.lit("● Normal"))
            .when(r < S.ERROR_LEVEL_ELEVATED_BELOW, F.lit("● Elevated")).otherwise(F.lit("● Critical")))
    level = (F.when(r < S.ERROR_LEVEL_NORMAL_BELOW, F.lit("normal"))
             .when(r < S.ERROR_LEVEL_ELEVATED_BELOW, F.lit("elevated")).otherwise(F.lit("critical")))
    return rate.select(fixed(r, 2).alias("value"), text.alias("delta"), level.alias("level"))


def dlq_state(depth: DataFrame) -> DataFrame:
    """P20 on ``dlq_depth`` output."""
    n = F.col("num_messages")
    return depth.select(n.alias("value"),
                        F.when(n == 0, F.lit("● Empty")).otherwise(F.lit("● Messages need recovery")).alias("delta"),
                        F.when(n == 0, F.lit("empty")).otherwise(F.lit("recovery")).alias("level"))
