"""Delisting manifest: sampled market history, listing intervals and the merged delisted list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.listing import (
    active_symbols, delisted_candidates, listing_intervals, merge_delisted, month_plan,
    monthly_sample_dates, require_every_month, sample_history,
)
from tidemark.sources.lists import write_manifest


@dataclass(frozen=True)
class Manifest:
    seen: DataFrame
    intervals: DataFrame
    delisted: DataFrame


def build_manifest(quotes: DataFrame, span: DataFrame, as_of: Column, instruments: DataFrame | None = None,
                   official: DataFrame | None = None, strict: bool = True) -> Manifest:
    """quotes: (symbol, name, date) of every market day; span: one row (start, end).

    One market day per month is enough to see who is listed. With the official list,
    listing spells end at delistings; without it, at long gaps.
    """
    days = quotes.select("date").distinct()
    sample = monthly_sample_dates(days, month_plan(span))
    seen = sample_history(quotes, require_every_month(sample) if strict else sample)
    intervals = listing_intervals(seen, delistings=official)
    active = None if instruments is None else active_symbols(instruments, as_of)
    return Manifest(seen, intervals, merge_delisted(official, delisted_candidates(intervals, as_of, active), active))


def extend_seen(seen: DataFrame, newer: DataFrame) -> DataFrame:
    """Resume: keep the stored log and add only months after its last one."""
    last = seen.agg(F.max(F.trunc("seen_date", "month"))).scalar()
    return seen.unionByName(newer.where(last.isNull() | (F.trunc("seen_date", "month") > last)))


def write_manifests(manifest: Manifest, folder: str, stamp: str) -> None:
    write_manifest(manifest.seen, f"{folder}/seen_raw_{stamp}")
    write_manifest(manifest.intervals, f"{folder}/seen_{stamp}")
    write_manifest(manifest.delisted, f"{folder}/delisted_{stamp}")
