"""The composed search of sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from sightline.operators import filters, joins, rollups


def search_sightings(s: DataFrame, cameras: DataFrame, matches: DataFrame, page: int = 1, limit: int = 20, reference: Column | None = None, min_visual: float = 0.0, **criteria: str | float | None) -> DataFrame:
    """One page of the sightings that meet all criteria, latest first, with camera, best match and the number of all.

    ``criteria`` are those of ``filters.search_filter``. With a ``reference`` vector, a column of s, sightings must have a
    cosine of ``min_visual`` to it. Only the rows of the page meet cameras and matches.
    """
    found = s.filter(filters.search_filter(**criteria))
    if reference is not None:
        found = filters.min_visual_similarity(found, reference, min_visual)
    rows = joins.with_best_match(joins.with_camera(rollups.page(found, page, limit), cameras), matches)
    return rollups.with_total(filters.sighting_view(rows), found)
