"""From raw articles and a price panel to the aligned modelling frame: the whole build as one plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import calendar as C
from ..operators import dedup as P
from ..operators import gates as G
from ..operators import quality as Q
from ..operators import targets as T
from ..operators import windows as N


@dataclass(frozen=True)
class Config:
    """What a build depends on. ``train_end`` and ``val_end`` close the first two splits."""

    primary: str = "USD_IDR"
    zone: str = "Asia/Jakarta"
    lag: int = 1
    band: float = 0.1
    train_end: str = "2024-06-30"
    val_end: str = "2024-09-30"
    families: tuple[str, ...] = ("conflict", "energy", "trade")
    tiers: Mapping[int, Iterable[str]] = field(default_factory=lambda: {1: ("reuters.com",), 2: ("bbc.com",)})
    state: tuple[str, ...] = ()
    block: tuple[str, ...] = ("*.blogspot.*", "msn.com")
    countries: tuple[str, ...] = ("US", "CH", "ID")
    terms: tuple[str, ...] = ("tariff", "oil price", "rupiah")


def flagged(articles: DataFrame, config: Config) -> DataFrame:
    """Articles with cluster columns, gate flags, ``keep`` and both text tracks; nothing is deleted."""
    out = P.deduplicate(articles, "article_id", "title", "url", "seen")
    out = G.source_gate(out, config.tiers, config.state, config.block)
    out = out.withColumns({"has_actor_country": F.upper("sourcecountry").isin(*config.countries), "has_market_term": X.mentions(F.col("title"), config.terms)})
    out = G.funnel(G.materiality(out, ["actor_country", "market_term"]))
    clean = X.unicode_repair("title")
    return out.withColumns({"text_track_a": X.track_a(clean), "text_track_b": X.track_b(clean), "local_date": C.local_date(F.col("seen"), config.zone)})


def daily_features(kept: DataFrame, config: Config) -> DataFrame:
    """One row a bucket: volume, syndication, tiers, families, their entropy, countries; and trailing scores."""
    wide = [F.count_if(F.col("theme_family") == f).alias(f"n_{f}") for f in config.families]
    tiers = [A.share(F.col("source_tier") == t).alias(f"share_tier{t}") for t in (1, 2, 3)]
    hours = F.greatest(F.any_value("window_hours"), F.lit(1.0))
    d = kept.groupBy(F.col("news_day").alias("date")).agg(
        F.count("*").alias("n_articles"), (F.count("*") * 24 / hours).alias("n_per_24h"), F.avg("dup_count").alias("dup_mean"), F.max("dup_count").alias("dup_max"),
        F.percentile("dup_count", 0.9).alias("dup_p90"), F.count_distinct("sourcecountry").alias("n_countries"), A.share(F.col("has_market_term")).alias("share_market_term"), *wide, *tiers,
    )
    total = sum((F.col(f"n_{f}") for f in config.families[1:]), F.col(f"n_{config.families[0]}"))
    parts = [F.try_divide(F.col(f"n_{f}"), total) for f in config.families]
    terms = [F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in parts]
    by = C.by_date()
    return d.withColumns(
        {"theme_entropy": sum(terms[1:], terms[0]), "log_n_articles": F.log1p("n_articles")} | {f"share_{f}": p for f, p in zip(config.families, parts, strict=True)} | {"volume_z30": N.rolling_z(F.col("n_per_24h"), by), "volume_z90": N.rolling_z(F.col("n_per_24h"), by, 90)}
    )


def build(articles: DataFrame, panel: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Return the modelling frame, the flagged articles and the problems found in the frame (none if clean).

    Features and market columns are those of ``lag`` rows before the label. Counts of a
    trading day without articles are 0; shares and scores stay null.
    """
    targets = T.make_targets(panel, config.primary, levels=[c for c in panel.columns if c not in ("date", config.primary)], band=config.band)
    calendar = C.trading_calendar(panel, config.primary)
    marked = flagged(articles, config)
    kept = C.attach_news_day(marked.where("keep"), calendar)
    counts = ["n_articles", *[f"n_{f}" for f in config.families]]
    features = C.reindex(daily_features(kept, config), calendar, counts)
    market = targets.select("date", *[c for c in targets.columns if c.startswith("chg_")])
    labels = targets.select("date", "y_return", "y_abs", "y_direction")
    frame = C.prediction_frame(features, market, labels, config.lag)
    frame = frame.withColumn("split", N.chronological_split(F.col("date"), config.train_end, config.val_end))
    numeric = frame.select("date", "y_return", "feature_lag_days", "split", *[c for c, t in frame.dtypes if t in ("double", "bigint", "int") and c not in ("y_return", "y_abs", "feature_lag_days")])
    return frame, marked, Q.leakage(numeric, "y_return")
