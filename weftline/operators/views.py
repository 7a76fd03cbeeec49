"""Adapter views: observations with the shape of captured pages, derived from the relational tables by fixed arithmetic.

A capture is a user (events) or an order bucket (lineitem); document order is the event id. Where the caller of a plan gives a
relation of a view's name, as `sources.observations` makes them from captures, the plan reads that.
"""

from __future__ import annotations

import functools


def observed(view):
    """The given relation of this name, else the one derived from the test tables."""

    @functools.wraps(view)
    def read(d) -> str:
        return f"SELECT * FROM {d.t(view.__name__)}" if view.__name__ in d.names else view(d)

    return read


@observed
def color_obs(d) -> str:
    return f"""
SELECT capture_id, ord, channel, interactive, semantic,
       least(255, cast(floor(k / 10) AS int) * 27 + (k % 3)) AS r, greatest(0, 250 - cast(floor(k / 10) AS int) * 24 - (k % 2)) AS g, (cast(floor(k / 10) AS int) * 61 + (k % 2)) % 256 AS b
FROM (SELECT user_id AS capture_id, event_id AS ord, cast({d.rx('props', '([0-9]+)', 1)} AS int) AS k, event_type = 'click' AS interactive, event_type = 'error' AS semantic,
             CASE event_type WHEN 'view' THEN 'background' WHEN 'click' THEN 'text' WHEN 'purchase' THEN 'border' WHEN 'signup' THEN 'fill' ELSE 'stroke' END AS channel
      FROM {d.t('events')}) kk"""


@observed
def type_samples(d) -> str:
    return f"""
SELECT capture_id, ord, k, 12.0 + (k % 8) * 4 + (k % 3) * 0.4 AS size_px, 400 + 100 * (k % 4) AS weight, (12 + (k % 8) * 4) * (1.2 + 0.1 * (k % 3)) AS line_height_px,
       CASE k % 5 WHEN 0 THEN '"Inter", sans-serif' WHEN 1 THEN 'Georgia, serif' WHEN 2 THEN '''JetBrains Mono'', monospace' WHEN 3 THEN 'system-ui, sans-serif' ELSE 'Sora,Arial' END AS font_family,
       CASE WHEN k % 25 = 0 THEN 'h1' ELSE 'p' END AS tag, CASE WHEN k % 4 = 0 THEN 'normal' ELSE concat('-0.', cast(k % 7 AS {'string' if d.spark else 'varchar'}), 'px') END AS letter_spacing
FROM (SELECT user_id AS capture_id, event_id AS ord, cast({d.rx('props', '([0-9]+)', 1)} AS int) AS k FROM {d.t('events')} WHERE event_type IN ('click', 'view')) kk"""


@observed
def spacing_obs(d) -> str:
    return f"SELECT user_id AS capture_id, event_id AS ord, cast(floor(value + 0.5) AS int) AS px FROM {d.t('events')} WHERE value > 0 AND value <= 256"


@observed
def css_obs(d) -> str:
    """Radius and shadow strings."""
    s = "string" if d.spark else "varchar"
    k = f"cast(k AS {s})"
    return f"""
SELECT capture_id, ord, k,
       CASE k % 7 WHEN 0 THEN '0px' WHEN 1 THEN '50%' WHEN 2 THEN '9999px' WHEN 3 THEN concat('0px 0px ', cast(k % 9 AS {s}), 'px ', cast(k % 9 AS {s}), 'px') WHEN 4 THEN concat(cast(k % 5 AS {s}), 'px ', cast(k % 3 AS {s}), 'px ', cast(k % 5 AS {s}), 'px') ELSE concat(cast(k % 13 AS {s}), 'px') END AS radius,
       CASE k % 6 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE concat('0px ', cast(k % 4 AS {s}), 'px ', cast(k % 11 * 1.5 AS {s}), 'px rgba(0, 0, 0, 0.2)') END AS shadow
FROM (SELECT user_id AS capture_id, event_id AS ord, cast({d.rx('props', '([0-9]+)', 1)} AS int) AS k FROM {d.t('events')}) kk"""


def boxes(d) -> str:
    """Boxes of elements: 100 captures with a stable document order."""
    return f"""
SELECT l_orderkey % 100 AS capture_id, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
       cast(l_partkey % 1440 AS double) AS x, cast(l_suppkey * 37 % 4000 AS double) AS y, cast(l_partkey * 7 % 600 AS double) AS w, cast(l_quantity * 4 AS double) AS h,
       l_linenumber, l_returnflag, l_linestatus, l_partkey, l_suppkey
FROM {d.t('lineitem')}"""


@observed
def pixel_hist(d) -> str:
    return f"""
SELECT l_orderkey % 100 AS capture_id, cast(l_partkey % 16 * 16 + l_suppkey % 3 AS int) AS r, cast(l_suppkey % 8 * 32 + l_partkey % 2 AS int) AS g, cast(l_partkey % 4 * 60 AS int) AS b,
       sum(cast(l_quantity AS bigint)) AS n, min(l_orderkey) AS first_ix
FROM {d.t('lineitem')} GROUP BY 1, 2, 3, 4"""
